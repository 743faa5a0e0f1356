"""Entities and keywords of sentences in any script, against Python's own word borders."""

import re
from collections import Counter

from pyspark.sql import functions as F

from pleonasm import lexicons as L
from pleonasm.catalog import load
from pleonasm.catalog import sqltext as S
from pleonasm.functions import signals


def entities(text):
    found = set(re.findall(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", text))
    return "|".join(sorted(found | set(re.findall(r"(?i)\bmy name is\s+([a-z][a-z'-]{2,})\b", text))))


def cluster_entities(text):
    body = re.sub(r"(?m)^\s*[A-Z][A-Za-z &/-]{1,50}:\s*", " ", text)
    found = re.findall(r"\b[A-Z][A-Za-z0-9]*(?:\s+[A-Z][A-Za-z0-9]*){0,3}\b", body)
    return "|".join(sorted(v for v in found if v not in L.CLUSTER_ENTITY_STOP))


def keywords(text):
    return sorted(set(re.findall(r"\b[a-z][a-z-]{3,}\b", text.lower())) - set(L.KEYWORD_STOP))


ODD = [
    "Paris liegt nicht in \u00d6sterreich, Zürich auch nicht.",
    "L'\u00c9cole Normale de Lyon et le Caf\u00e9 Central.",
    "Cafe\u0301 Noir and Re\u0301sume writer.",
    "El ni\u00f1o Carlos vive en Espa\u00f1a con Mar\u00eda Lopez.",
    "New\u00a0York \u00fcber Alles, my name is jos\u00e9 or my name is anne-marie\u00e9.",
    "\u4e1c\u4eacTokyo Tower, \u0130stanbul Turkey well-known- words",
    "",
]


def test_borders_are_those_of_any_script(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "id int, s string")
    s = F.col("s")
    got = df.select("id", F.array_join(signals.named_entities(s), "|"), F.array_join(signals.cluster_entities(s), "|"), signals.keywords(s)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == {i: (entities(t), cluster_entities(t), keywords(t)) for i, t in enumerate(ODD)}


def test_no_sentence_is_left_out(spark, folder, duck):
    sentences = duck.execute(S.rows("documents", "doc_id", S.sentences("text"), "sentence")).fetchall()
    assert any(not s.isascii() for *_, s in sentences)
    got = load()["sentence_entities"].build(spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted((d, p, entities(s), cluster_entities(s)) for d, p, s in sentences)
    counts = load()["keyword_counts"].build(spark, folder).collect()
    assert {r.keyword: r.sentences for r in counts} == Counter(k for *_, s in sentences for k in keywords(s))
