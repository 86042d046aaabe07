import itertools
import math
import os
from collections import Counter

import numpy as np
import pytest

from labelloom.llm.subword_lattice import SPACE, Lattice, Vocabulary, decode, encode_batch, ids_of, log_inclusion, row_key, sample_encode, split

MODEL = os.environ.get("TOKENIZERS", "/opt/tokenizers") + "/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary file")


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load(MODEL)


def segmentations(text, v):
    """Every segmentation with its probability, by plain enumeration over the whole text."""
    index = {p: i for i, p in enumerate(v.pieces) if np.isfinite(v.scores[i])}
    whole = (SPACE + text.replace(SPACE, "\udc00").replace(" ", SPACE)) if text else ""

    def go(at):
        if at == len(whole):
            yield (), 0.0
            return
        for end in range(at + 1, min(len(whole), at + 16) + 1):
            part = whole[at:end]
            if part in index:
                head, score = (index[part],), v.scores[index[part]]
            elif end == at + 1:
                raw = part.replace("\udc00", SPACE).encode()
                head, score = tuple(v.byte_ids[list(raw)].tolist()), v.byte_score * len(raw)
            else:
                continue
            for tail, more in go(end):
                yield head + tail, score + more

    found = dict(go(0))
    total = math.log(sum(map(math.exp, found.values())))
    return {k: math.exp(s - total) for k, s in found.items()}


def test_units():
    for text in ("", "a", "a b", " a", "a ", "  a  b ", "   ", "a\nb c", " ", "\n", "\n\na", "a \nb", "a\n b", "  \n  a\n", "a  b\nc\n\n d", " \n"):
        assert "".join(u if u.startswith("\n") else " " + u for u in split(text)) == (" " + text if text else ""), text


def test_masses_and_round_trip(vocabulary):
    for text in ("of", "the cat", " a  b", "é\n", "\na \n", "x😀", "▁", "\x00 ", "a" * 9):
        want = segmentations(text, vocabulary)
        seen = {}
        for threshold, samples in encode_batch([row_key(i, 3) for i in range(300)], [text] * 300, vocabulary, 3, 1.0):
            values = [s[0] for s in samples]
            assert values == sorted(values, reverse=True) and threshold <= values[-1]
            ids = [tuple(ids_of(p, vocabulary).tolist()) for *_, p in samples]
            assert len(set(ids)) == len(ids) == min(3, len(want))
            assert (threshold == -np.inf) == (len(want) <= 3)
            for key, (_, log_prob, _) in zip(ids, samples, strict=True):
                assert math.isclose(math.exp(log_prob), want[key], rel_tol=1e-9), text
                assert vocabulary.decode(list(key)) == text
                seen[key] = log_prob


def test_samples_without_replacement_have_the_right_shares(vocabulary):
    text, n, sharpness = "on it", 30000, 0.25
    want = segmentations(text, vocabulary)
    total = sum(p**sharpness for p in want.values())
    want = {k: p**sharpness / total for k, p in want.items()}
    found = encode_batch([row_key(i, 1) for i in range(n)], [text] * n, vocabulary, 2, sharpness)
    firsts = Counter(tuple(ids_of(s[0][2], vocabulary).tolist()) for _, s in found)
    pairs = Counter(tuple(tuple(ids_of(x[2], vocabulary).tolist()) for x in s) for _, s in found)
    assert 4 <= len(want) <= 60
    for k, p in want.items():
        assert abs(firsts[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-9
    for a, b in itertools.permutations(want, 2):
        p = want[a] * want[b] / (1 - want[a])
        assert abs(pairs[a, b] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 3 / n
    # inclusion scores weigh samples so that sums over them are unbiased
    weights = [sum(math.exp(lp - log_inclusion(lp, t)) for _, lp, _ in s) for t, s in found]
    assert abs(np.mean(weights) - 1) < 5 * np.std(weights) / math.sqrt(n)


def test_lattice_of_long_unit(vocabulary):
    lattice = Lattice(["9" * 70000, "x"], vocabulary, 1.0)
    whose, edges = lattice.walk(lattice.start, np.array([1, 2], np.uint64))
    assert set(whose.tolist()) == {0, 1} and lattice.target[edges[-1]] == lattice.end


def test_rows(docs):
    rows = [(1, None), (2, ""), (3, "The quick brown fox"), (3, "The quick brown fox"), (None, "The quick brown fox"), (4, "the word " * 20000), (5, " \n\t é😀▁ "), (6, "a")]
    got = sample_encode(docs(rows).repartition(3), MODEL, k=2).collect()
    by = {}
    for r in got:
        assert r.round_trip and r.n_pieces == len(r.ids) and -math.inf < r.log_inclusion <= 0
        by.setdefault(r.doc_id, []).append(r)
    assert [len(by[i]) for i in (1, 2, 3, None, 4, 5)] == [1, 1, 4, 2, 2, 2] and by[1][0].n_pieces == 0
    assert len({tuple(r.ids) for r in by[3]}) == 2 and {r.perturbed for r in by[3]}.isdisjoint(r.perturbed for r in by[None])
    alone = {(r.doc_id, r.sample): (tuple(r.ids), r.perturbed, r.log_inclusion) for r in sample_encode(docs([rows[2], rows[6]]), MODEL, k=2).collect()}
    assert all(alone[r.doc_id, r.sample] == (tuple(r.ids), r.perturbed, r.log_inclusion) for i in (3, 5) for r in by[i])
    frame = sample_encode(docs(rows), MODEL, k=1)
    assert sorted(str(r.text) for r in decode(frame, MODEL).collect()) == sorted(t or "" for _, t in rows)
    assert sample_encode(docs([]), MODEL).count() == 0
