from pleonasm.llm.chat import rotate_perspectives

SCHEMA = "conversation_id long, turn long, role string, content string"


def brute(rows):
    out = []
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0), r[2] if r[2] is not None else "unknown", r[3] or "") for r in rows if r[0] == c)
        for p in sorted({t[1] for t in turns} - {"system"}):
            text, mask = "", []
            for _, speaker, content in turns:
                text += "<|system|>\n" if speaker == "system" else "<|assistant|>\n" if speaker == p else f"<|user:{speaker}|>\n"
                start = len(text)
                text += content + "<|end|>\n"
                if speaker == p:
                    mask.append((start, len(text)))
            out.append((c, p, len(turns), len(mask), text, tuple(mask)))
    return sorted(out, key=str)


def result(frame):
    return sorted(((r[0], r[1], r[2], r[3], r[4], tuple(map(tuple, r[5]))) for r in frame.collect()), key=str)


ROWS = [
    (1, 0, "system", "Be brief."), (1, 1, "ann", "Hello"), (1, 2, "bob", "Hi 🤦 é"), (1, 3, "ann", ""), (1, 4, "cy", None),
    (2, 1, "user", "same turn"), (2, 1, "assistant", "same turn"), (2, 1, "user", "same turn"), (2, None, "user", "no turn"),
    (3, 0, "system", "alone"), (4, 0, None, "nobody"), (None, 0, "user", "no id"), (None, 1, "assistant", "x" * 100_000),
]


def test_every_view(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    assert result(rotate_perspectives(frame)) == brute(ROWS)


def test_masks_cut_out_own_turns(spark):
    for r in rotate_perspectives(spark.createDataFrame(ROWS, SCHEMA)).collect():
        own = [x[3] or "" for x in ROWS if x[0] == r.conversation_id and (x[2] or "unknown") == r.participant]
        assert sorted(r.text[a:b] for a, b in r["mask"]) == sorted(o + "<|end|>\n" for o in own)


def test_names_cannot_end_the_mark_and_extra_columns(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(1, 0, "a|>\nb", "x"), (1, 1, "c", "y")], SCHEMA).withColumns({n: F.lit("q") for n in ("c", "t", "turns", "parts", "participant", "text", "mask")})
    texts = {r.participant: r.text for r in rotate_perspectives(frame).collect()}
    assert texts["c"].startswith("<|user:a_b|>\nx")
    assert rotate_perspectives(frame.where("false")).count() == 0
