import re
from collections import Counter, defaultdict

import pytest

from labelloom.llm import common
from labelloom.llm.source_audit import source_divergence, term_counts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, added=5, top=50):
    """rows: text, lang, source. The whole result by loops over documents and terms."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((a or "", b or "", c or "") for a, b, c in rows):
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))
        groups[lang].add(source)
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    found = []
    for lang, sources in groups.items():
        kept = sorted(w for w, n in docs[lang].items() if n >= min_docs)

        def chances(names, kept=kept, lang=lang):
            n = {w: sum(counts[lang, s][w] for s in names) for w in kept}
            return {w: 1 + 1_000_000_000 * (n[w] + added) // (sum(n.values()) + added * len(kept)) for w in kept}

        p, q = {s: chances([s]) for s in sources}, chances(sources)
        for s in sources:
            pair = [(-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode(), o) for o in sources if o != s]
            term = [(q[w] - p[s][w], w.encode(), w) for w in kept if counts[lang, s][w] > 0 and p[s][w] > q[w]]
            for part, each in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                found += [(lang, s, part, item, -value, i) for i, (value, _, item) in enumerate(each, 1)]
    return sorted(found)


def result(frame, **how):
    return sorted(tuple(r) for r in source_divergence(frame, **how).select("lang", "source", "part", "item", "value", "rank").collect())


ROWS = [
    *((i, "The tree THE tree Ärger ärger " * (1 + i % 3) + ("only here" if i % 4 == 0 else ""), "en", f"s{i % 4}") for i in range(24)),
    *((100 + i, "ein Baum, ein Haus; 12 Häuser\nÄrger " + "weit " * (i % 5), "de", f"s{i % 2}") for i in range(9)),
    (200, None, "en", "s0"), (201, "", "en", "empty"), (202, "12 34 -- ..", "en", "marks"), (203, "alone in a language", "fr", "s0"), (204, "alone too", "fr", "s1"), (205, "one two", None, None), (206, "one", None, "s9"),
    (207, "日本 𝒜bc 日本", "en", "s1"), (208, "the " * 20_000, "en", "s2"), (1, "the tree", "en", "s1"), (1, "the tree", "en", "s1"),
]


@pytest.mark.parametrize("min_docs", [1, 3, 8])
def test_equals_loops(docs, min_docs):
    assert result(docs(ROWS).repartition(3), min_docs=min_docs, top=3) == brute([r[1:] for r in ROWS], min_docs, top=3)


def test_nothing_kept_gives_pairs_at_distance_zero(docs):
    rows = [(1, "a b", "en", "s1"), (2, "c", "en", "s0"), (3, "d", "de", "s0")]
    assert result(docs(rows)) == [("en", "s0", "pair", "s1", 0, 1), ("en", "s1", "pair", "s0", 0, 1)] == brute([r[1:] for r in rows], 30)


def test_empty_table(docs):
    assert result(docs(ROWS).limit(0)) == []


def test_shuffled_joins_give_the_same(docs, monkeypatch):
    want = result(docs(ROWS), min_docs=3)
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    assert result(docs(ROWS), min_docs=3) == want


def test_a_row_counts_a_term_once_as_document(docs):
    got = {(r.source, r.term): (r.n, r.docs) for r in term_counts(docs([(1, "A a b", "en", "x"), (2, "a", "en", "x"), (3, "a", "en", "y")])).collect()}
    assert got == {("x", "a"): (3, 2), ("x", "b"): (1, 1), ("y", "a"): (1, 1)}
