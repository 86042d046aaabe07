import hashlib

from labelloom.llm.line_dedup import STRIPPED, line_dedup


def brute(rows):
    order = lambda i: (i is None, i or 0)
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(STRIPPED))
    first = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(k := key(line)) >= 10 and (k not in first or order(i) < order(first[k])):
                first[k] = i
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark, docs):
    hot = "The very same line in all"
    rows = [(i, f"{hot}\nown line number {i}\n  {hot.upper()} \t\nshort\nshared by some {i % 7}") for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "\n\n"), (None, f"{hot}\nof no id at all"), (None, "of no id at all"), (1003, "Ünïcode Lïne Ünïcode"), (1004, "ünïcode lïne ünïcode"), (1005, "ÜnïcODE lïne Ünïcode")]
    rows += [(5, rows[5][1]), (2000, "\n".join(f"line of a long text {j}" for j in range(20000))), (2001, "\n".join(f"line of a long text {j}" for j in range(0, 20000, 3)))]
    for partitions in ("4", "23"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = [tuple(r) for r in line_dedup(docs(rows).repartition(5), digest=True).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()]
        assert sorted(got, key=str) == brute(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_text_and_empty(docs):
    got = {r.doc_id: r.text for r in line_dedup(docs([(2, "a line of text\nb"), (1, "A LINE OF TEXT"), (3, None)])).collect()}
    assert got == {1: "A LINE OF TEXT", 2: "b", 3: ""}
    assert line_dedup(docs([])).count() == 0
