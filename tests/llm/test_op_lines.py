import pytest

from pleonasm.llm import lines as L

SPACE = " \t\n\x0b\x0c\r"


def brute(rows, least, shortest=1):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keys = [[line.strip(SPACE).translate(lower) for line in (t or "").split("\n")] for _, t in rows]
    count = {}
    for ks in keys:
        for k in set(ks):
            count[k] = count.get(k, 0) + 1
    out = []
    for (i, t), ks in zip(rows, keys, strict=True):
        kept = [line for line, k in zip((t or "").split("\n"), ks, strict=True) if len(k) < shortest or count[k] < least]
        out.append((i, "\n".join(kept), len(ks), len(ks) - len(kept)))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


@pytest.mark.parametrize("least,shortest", [(2, 1), (3, 1), (10, 1), (2, 18)])
def test_edges(edges, edge_rows, least, shortest):
    found = L.drop_repeated_lines(edges, min_prompts=least, shortest=shortest).select("prompt_id", "text", "n_lines", "n_dropped").collect()
    assert ordered(map(tuple, found)) == ordered(brute(edge_rows, least, shortest))


def test_first_occurrence_stays(spark):
    rows = [(3, "A line\nother"), (1, "x\na LINE "), (2, "A line"), (1, "y")]
    prompts = spark.createDataFrame(rows, "prompt_id long, text string")
    found = L.drop_repeated_lines(prompts, min_prompts=3, keep_first=True)
    assert sorted((r.prompt_id, r.text) for r in found.collect()) == [(1, "x\na LINE "), (1, "y"), (2, ""), (3, "other")]


def test_full_filters_change_nothing(edges, edge_rows):
    found = L.drop_repeated_lines(edges, min_prompts=2, filter_bits=64).select("prompt_id", "text", "n_lines", "n_dropped").collect()
    assert ordered(map(tuple, found)) == ordered(brute(edge_rows, 2))


def test_few_false_suspects(spark):
    rows = [(i, "\n".join([f"only {i} {j}" for j in range(20)] + ["shared"])) for i in range(300)]
    prompts = spark.createDataFrame(rows, "prompt_id long, text string").repartition(4)
    from pyspark.sql import functions as F

    bits = L._filter_bits(prompts, "text", 1 << 28)
    found = L.suspects(prompts, "text", 1, bits, F.struct("prompt_id"))
    assert found.where("line_key = 'shared'").count() == 300
    assert found.where("line_key <> 'shared'").count() < 0.05 * 6000


def test_empty_table_and_carried_columns(nothing, edges):
    assert L.drop_repeated_lines(nothing).count() == 0
    assert L.drop_repeated_lines(edges, carry=("id", "row")).columns == ["prompt_id", "text", "n_lines", "n_dropped", "id", "row"]
