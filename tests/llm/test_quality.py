import math
import random
import re

import numpy as np

from labelloom.llm.quality import Rules, js_distance, keep_good, quality


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def prose(rng, n):
    common = ["the", "of", "and", "to", "in", "is", "that"]
    return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("etaoinsh") for _ in range(rng.randint(2, 8))) for _ in range(n)) + "."


def test_base_counts(docs):
    rng = random.Random(2)
    texts = [None, "", " \t\n", "one", "a b c d e a b c d e", "a b c d e f a b c d e", "x\nx\n x\n\n\nx", "é ü # * <\x1cz>", "ab " * 9, "ab " * 30]
    texts += ["".join(rng.choice("ab \n#é") for _ in range(rng.randint(0, 80))) for _ in range(150)]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in quality(docs(rows)).collect()}
    for i, t in rows:
        r, want = got[i], base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_distance():
    p, q = np.array([[1, 1, 0], [2, 0, 0], [0, 0, 0]]), np.array([[1, 1, 0], [0, 3, 0], [1, 1, 1]])
    assert js_distance(p, q).tolist() == [0.0, 1.0, 0.0]
    assert math.isclose(js_distance(np.array([[1, 0]]), np.array([[1, 1]]))[0], math.sqrt(0.311278124), rel_tol=1e-6)


def test_strange_texts_go_and_prose_stays(docs):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(70, 400)), "en") for i in range(60)]
    rows += [(100 + i, " ".join(w + "%%%" for w in prose(rng, 200).split()), "en") for i in range(3)]
    rows += [(200 + i, prose(rng, 200).upper(), "en") for i in range(3)]
    rows += [(300, prose(rng, 30), "en"), (301, prose(rng, 200), None), (302, prose(rng, 20000), "en"), (None, prose(rng, 100), "en")]
    frame = docs(rows)
    kept = {r.doc_id for r in quality(frame).where("kept").collect()}
    assert kept == {*range(60), 300, 301, 302, None}
    whole = keep_good(frame)
    assert whole.schema == frame.schema and {r.doc_id for r in whole.collect()} == kept


def test_many_languages_fall_back_to_the_sum(docs):
    rng = random.Random(9)
    rows = [(i, prose(rng, 150), f"l{i % 6}") for i in range(30)]
    assert quality(docs(rows), Rules(max_languages=2)).where("kept").count() == 30


def tongue(rng, k, n):
    """Prose of a language with common words of its own."""
    common = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{i}" for i in range(7)]
    return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("etaoinsh") for _ in range(rng.randint(2, 8))) for _ in range(n)) + "."


def test_further_languages_and_none_are_held_against_their_own(docs):
    rng = random.Random(12)
    rows = [(i, tongue(rng, 0, 300), "l0") for i in range(300)]
    rows += [(1000 + 10 * k + i, tongue(rng, k, 200), f"l{k}") for k in range(1, 260) for i in range(2)]
    rows += [(10000 + k, tongue(rng, k, 200), None) for k in range(0, 260, 20)]
    junk = [(20000 + i, " ".join(f"{i}x{j}" for j in range(200)), None) for i in range(3)]
    kept = {r.doc_id for r in quality(docs(rows + junk)).where("kept").collect()}
    assert kept == {r[0] for r in rows}
    assert {r.doc_id for r in keep_good(docs(rows + junk)).collect()} == kept


def test_no_language_at_all(docs):
    rng = random.Random(13)
    rows = [(i, prose(rng, 200), None) for i in range(30)]
    junk = [(100, " ".join(f"x{j}" for j in range(200)), None)]
    assert {r.doc_id for r in quality(docs(rows + junk)).where("kept").collect()} == set(range(30))


def test_empty(docs):
    assert quality(docs([])).count() == 0 and keep_good(docs([])).count() == 0


def test_distances_and_verdicts_by_loops(docs):
    """Histograms, distances and verdicts counted anew for every document."""
    import math
    from collections import Counter

    rng = random.Random(21)
    rows = [(i, prose(rng, rng.randint(20, 200)) + rng.choice(["", "!", " 12 %", "\n"]), rng.choice(["en", "de"])) for i in range(60)]
    rows += [(100, "x9%% " * 150, "en"), (101, " ".join(f"q{i}" for i in range(90)), "en"), (102, "", "de"), (103, None, "de")]
    rules = Rules()
    kind = lambda c: "lower" if c in "abcdefghijklmnopqrstuvwxyz" else "upper" if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else "digit" if c in "0123456789" else "space" if c in " \t\n\v\f\r" else "stop" if c in ".,;:'\"-" else "symbol" if c in "#*$%&|<>" else "mark" if ord(c) < 128 else "beyond"
    words = lambda t: (t or "").split()
    refs = {}
    for lang in ("en", "de"):
        own = [t or "" for _, t, k in rows if k == lang]
        counts = Counter(w for t in own for w in words(t))
        top = sorted(counts, key=lambda w: (-counts[w], w))[: rules.common_words]
        refs[lang] = Counter(kind(c) for t in own for c in t), {w: counts[w] for w in top}

    def distance(a, b):
        if not sum(a.values()) or not sum(b.values()):
            return 0.0
        p, q = ({k: v / sum(x.values()) for k, v in x.items()} for x in (a, b))
        part = lambda r: sum(v * math.log2(v / ((p.get(k, 0) + q.get(k, 0)) / 2)) for k, v in r.items() if v)
        return math.sqrt(max(0.0, (part(p) + part(q)) / 2))

    got = {r.doc_id: r for r in quality(docs(rows)).collect()}
    for i, t, lang in rows:
        classes, common = refs[lang]
        own = Counter(w for w in words(t) if w in common)
        a, b, n = distance(Counter(map(kind, t or "")), classes), distance(own, common), len(words(t))
        assert math.isclose(got[i].class_distance, a, abs_tol=1e-9) and math.isclose(got[i].word_distance, b, abs_tol=1e-9)
        far = b if own else 1.0
        strange = (len(t or "") >= rules.guard_chars and a > rules.max_class_distance) or (n >= rules.guard_words and far > rules.max_word_distance + rules.word_slack / math.sqrt(max(n, 1)))
        assert got[i].kept == (not got[i].base_failed and not strange), i
    assert not got[100].kept and not got[101].kept


def test_no_document_is_its_language_s_only_judge(docs):
    rng = random.Random(31)
    junk = " ".join("".join(rng.choice("qxzkvwj0189") for _ in range(rng.randint(4, 11))) for _ in range(300))
    rows = [(i, prose(rng, 150), "en") for i in range(40)]
    odd = [(100, junk, "xx"), (101, junk, "en"), (102, prose(rng, 200), "yy"), (103, "", "zz"), (104, None, "zz")]
    got = {r.doc_id: r for r in quality(docs(rows + odd)).collect()}
    assert not got[100].kept and not got[101].kept and got[102].kept and all(got[i].kept for i in range(40))
    assert got[100].class_distance > 0.3 and got[100].judged_distance == got[101].judged_distance == 1.0
    # alone in the table, it has nothing else to be held against
    assert quality(docs(odd[:1])).first().kept


def test_references_are_bounded_by_their_share(docs):
    from labelloom.llm.quality import _inputs, references

    rng = random.Random(32)
    rows = [(i, prose(rng, 400), "en") for i in range(20)] + [(100 + i, "x", f"dirty{i}") for i in range(50)]
    inputs = _inputs(docs(rows), "text", "lang")
    assert set(references(inputs, Rules())) == {"en"} and len(references(inputs, Rules(most_references=10**9))) == 51
    assert {r.doc_id for r in quality(docs(rows)).where("kept").collect()} == set(range(20))
