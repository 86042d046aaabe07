import hashlib

from pyspark.sql import functions as F

from labelloom.llm.mixing import Mix, mix_sources, mixed


def share(total, nodes):
    """nodes: path -> (weight, cap). Units one by one to the node that is least served by its weight would tend to the same; here by rounds."""
    out = dict.fromkeys(nodes, 0)
    live = {k for k, (w, c) in nodes.items() if w > 0 and c > 0}
    full = set()
    while live:
        left = total - sum(nodes[k][1] for k in full)
        weight = sum(nodes[k][0] for k in live)
        over = {k for k in live if nodes[k][1] * weight <= nodes[k][0] * left}
        if not over:
            floors = {k: nodes[k][0] * left // weight for k in live}
            extra = left - sum(floors.values())
            for i, k in enumerate(sorted(live)):
                out[k] = floors[k] + (i < extra)
            break
        full |= over
        live -= over
    for k in full:
        out[k] = nodes[k][1]
    return out


def brute(rows, mix, domain_of):
    n = {i: len((t or "").split()) for i, t, *_ in rows}
    leaves = {}
    for i, t, lang, source in rows:
        leaves.setdefault((domain_of(source), lang, source), []).append((i, t))
    tokens = {k: sum(n[i] for i, _ in v) for k, v in leaves.items()}
    weight = lambda *p: mix.weights.get("/".join(p), mix.default_weight)
    live = lambda k: min(weight(k[0]), weight(*k[:2]), weight(*k)) > 0
    cap = {k: tokens[k] * mix.max_epochs if live(k) else 0 for k in leaves}
    budget = mix.budget if mix.budget is not None else sum(tokens.values()) * mix.budget_percent // 100
    given = {(): budget}
    for depth in (1, 2, 3):
        for parent in [p for p in given if len(p) == depth - 1]:
            kids = {k[:depth] for k in leaves if k[: depth - 1] == parent}
            given |= share(given[parent], {k: (weight(*k), sum(c for x, c in cap.items() if x[:depth] == k)) for k in kids})
    out = {}
    for leaf, own in leaves.items():
        epochs, rest = divmod(given[leaf], tokens[leaf]) if tokens[leaf] else (0, 0)
        at = 0
        for i, t in sorted(own, key=lambda x: (hashlib.md5(f"{mix.seed}:{epochs}:{x[0]}".encode()).hexdigest(), hashlib.md5((x[1] or "").encode()).hexdigest())):
            out[i] = (epochs, max(0, min(n[i], rest - at)))
            at += n[i]
    return out, given


def corpus(size):
    names = [("en", "a1"), ("en", "a1"), ("en", "a1"), ("en", "b2"), ("de", "a1"), ("fr", "b2"), ("de", "c3"), ("fr", "a1")]
    return [(i, None if i % 50 == 7 else "w " * (i * 7 % 23), *names[i * i % 8]) for i in range(size)]


def test_against_brute_force(docs):
    rows = corpus(9000)
    domain = F.substring("source", 1, 1)
    for mix in (
        Mix(), Mix(weights={"a": 5, "b": 1, "a/en": 3, "a/de": 9, "b/en/b2": 4}, budget_percent=150, max_epochs=2, seed=3),
        Mix(weights={"a": 0, "b": 7}, budget_percent=90, max_epochs=3), Mix(budget=0), Mix(budget=10**9, max_epochs=2), Mix(weights={"a": 1000, "b/fr": 0}, budget=30011),
    ):
        want, _ = brute(rows, mix, lambda s: s[0])
        got = mix_sources(docs(rows), mix, domain).select("doc_id", "_mix.*").collect()
        assert {r.doc_id: (r.full_epochs, r.tail_tokens) for r in got} == want
        assert all(r.copies == r.full_epochs + (r.tail_tokens > 0) for r in got)


def test_shortage_goes_to_siblings_first():
    rows = [(i, "w " * 10, "en", "a1") for i in range(10)] + [(100 + i, "w " * 10, "en", "a2") for i in range(90)] + [(200 + i, "w " * 10, "en", "b1") for i in range(100)]
    _, given = brute(rows, Mix(budget=1000, max_epochs=1), lambda s: s[0])
    assert given[("a",)] == given[("b",)] == 500 and given[("a", "en", "a1")] == 100 and given[("a", "en", "a2")] == 400


def test_odd_rows(docs):
    rows = [(1, "a b c", None, None), (1, "a b c", None, None), (None, "d e", "en", "a1"), (2, "", "en", "a1"), (3, "w " * 30000, "en", "a1")]
    got = mix_sources(docs(rows), Mix(budget_percent=100), F.lit(None)).select("doc_id", "text", "h", "kept", "_mix.*").collect()
    assert len(got) == 5 and sum(r.full_epochs * r.n_tokens + r.tail_tokens for r in got) == 30008
    assert {r.h for r in got} == {7} and {r.lang for r in got} == {"none", "en"}
    frame = docs(rows)
    twice = mixed(frame, Mix(budget_percent=200), F.lit("d"))
    assert twice.columns == frame.columns and twice.where("doc_id = 1").count() == 2 * 4  # a leaf of 6 tokens, due for half of 60016: max_epochs
    assert mix_sources(docs([]), Mix(), F.lit("d")).count() == 0


def test_leaves_give_their_targets_to_the_token(docs):
    rows = [(i, f"one\n two  three {i}\tfive ", "en", f"a{i % 3}") for i in range(50)] + [(None, f"x{i} y", "de", "b1") for i in range(30)] + [(None, "same same", "de", "b1")] * 9
    mix = Mix(budget_percent=130, seed=2)
    frame = docs(rows).withColumnRenamed("h", "_m_tokens").withColumnRenamed("kept", "_row")
    taken = mixed(frame, mix, F.substring("source", 1, 1))
    assert taken.columns == frame.columns
    got = {(r.lang, r.source): r.n for r in taken.groupBy("lang", "source").agg(F.sum(F.size(F.expr("filter(split(text, '[ \\\\t\\\\n]+'), w -> w != '')"))).alias("n")).collect()}
    due = mix_sources(frame, mix, F.substring("source", 1, 1)).groupBy("lang", "source").agg(F.sum(F.expr("_mix.full_epochs * _mix.n_tokens + _mix.tail_tokens")).alias("n")).collect()
    assert got == {(r.lang, r.source): r.n for r in due} and sum(got.values()) == sum(len(t.split()) for _, t, *_ in rows) * 130 // 100
    texts = {t for _, t, *_ in rows}
    assert all(r.text in texts or any(t.startswith(r.text) for t in texts) for r in taken.select("text").collect())
