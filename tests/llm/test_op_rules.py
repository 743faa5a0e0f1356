import re

from pleonasm.llm import rules as R

SPLIT = "[^\x20\x09-\x0d]+"


def brute(text):
    text = text or ""
    w = re.findall(SPLIT, text)
    count, covered = {}, set()
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    for x in windows:
        count[x] = count.get(x, 0) + 1
    for i, x in enumerate(windows):
        if count[x] > 1:
            covered.update(range(i, i + 8))
    lines = [line for line in text.split("\n") if re.search(SPLIT, line)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_edges(edges, edge_rows, nothing):
    found = R.judge_prompts(edges).collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((str(r.prompt_id), *(r[c] for c in columns)) for r in found) == sorted((str(k), *brute(t)) for k, t in edge_rows)
    assert R.judge_prompts(nothing).count() == 0


def test_hosts_of_few_prompts_are_drawn_to_the_rest(spark):
    good, bad = " ".join(f"word{i}" for i in range(30)), "too short"
    rows = [(f"h{h}", good if i else bad) for h in range(20) for i in range(10)]  # one failure in ten
    rows += [("junk", bad)] * 200 + [("junk", good)] * 3 + [("tiny", bad), ("tiny", good), (None, good), (None, bad)]
    prompts = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "prompt_id long, text string, host string")
    found = {r.prompt_id: r for r in R.judge_prompts(prompts).collect()}
    kept = {}
    for i, (h, t) in enumerate(rows):
        kept.setdefault((h, t == good), set()).add(found[i].kept)
    assert kept[("junk", True)] == {False} and kept[("h3", True)] == {True} and kept[("tiny", True)] == {True} and kept[(None, True)] == {True}
    assert all(v == {False} for (h, ok), v in kept.items() if not ok)
    rate = found[rows.index(("tiny", bad))].host_rate
    assert 0.1 < rate < 0.5
    assert {r.prompt_id for r in found.values() if r.host_failed} == {i for i, (h, _) in enumerate(rows) if h == "junk"}


def test_one_host_of_many_stands_out_by_any_rule(spark):
    good = " ".join(f"word{i}" for i in range(30))
    kinds = {"words": "too short", "symbols": good + " $$$ ### *** &&& %%%", "lines": good + "\nsame\nsame\nsame", "repeats": "one two three four five six seven eight " * 4}
    for rule, bad in kinds.items():
        rows = [(f"h{h}", bad if i % 100 < 9 else good) for h in range(12) for i in range(200)]
        rows += [("odd", bad if i % 100 < 40 else good) for i in range(400)]
        prompts = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "prompt_id long, text string, host string")
        found = {r.prompt_id: r for r in R.judge_prompts(prompts).collect()}
        assert {rows[i][0] for i, r in found.items() if r.host_failed} == {"odd"}, rule
        assert all(r.kept == (not r.base_failed and rows[i][0] != "odd") for i, r in found.items())


def test_one_host_and_hosts_alike_do_not_stand_out(spark):
    rows = [("only", "too short" if i % 2 else " ".join(f"w{j}" for j in range(30))) for i in range(60)]
    alike = rows + [(f"like{h}", t) for h in range(5) for _, t in rows]
    for some in (rows, alike):
        prompts = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(some)], "prompt_id long, text string, host string")
        assert not any(r.host_failed for r in R.judge_prompts(prompts).collect())


def test_host_of_a_url(spark):
    urls = ["https://Me@News.Example.com:80/a?b", "http://x", "ftp://h.example#f", "no url", None, "//x/y"]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    from pyspark.sql import functions as F

    assert [r[0] for r in frame.select(R.host_of(F.col("url"))).collect()] == ["news.example.com", "x", "h.example", None, None, None]
