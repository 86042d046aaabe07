import hashlib

import numpy as np

from labelloom.llm import exact_dedup as exchange
from labelloom.llm.exact_dedup import exact_dedup, rice_decode, rice_encode


def test_rice_round_trip():
    rng = np.random.default_rng(3)
    for bits in (60, 64, 20):
        for n in (0, 1, 2, 700):
            base = 0 if bits == 64 else 3 << bits
            values = np.unique(rng.integers(0, 2**bits - 1, n, dtype=np.uint64, endpoint=True)) + np.uint64(base)
            k, unary, rest = rice_encode(values, base, bits)
            assert (rice_decode(len(values), k, unary, rest, base) == values).all()
    edge = np.array([0, 1, 2**64 - 1], np.uint64)
    assert (rice_decode(3, *rice_encode(edge, 0, 64), 0) == edge).all()


def test_groups(docs):
    rows = [(i, f"text {i % 40}") for i in range(200)] + [(500, None), (501, ""), (502, "alone"), (None, "alone"), (None, None), (600, "z" * 300000), (601, "z" * 300000)]
    rows += [(700, "twice"), (700, "twice"), (700, "other"), (None, "null twice"), (None, "null twice")]
    got = exact_dedup(docs(rows).repartition(6)).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(i)
    for t, ids in texts.items():
        own = [r for r in got if r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()]
        best = max((i for i in ids if i is not None), default=None)
        assert len(own) == len(ids) and {r.group_size for r in own} == {len(ids)} and {r.keep_id for r in own} == {best}
        kept = [r for r in own if r.kept]
        assert len(kept) == 1 and kept[0].doc_id == best
    assert exact_dedup(docs([])).count() == 0


def test_many_owners_and_senders(docs, monkeypatch):
    monkeypatch.setattr(exchange, "OWNER_ROWS", 8)
    monkeypatch.setattr(exchange, "SENDER_ROWS", 50)
    monkeypatch.setattr(exchange, "BLOCK_ROWS", 2)
    assert exchange.shares(1000) == (7, 4)
    rows = [(i, f"text {i * i % 613}") for i in range(1000)]
    got = exact_dedup(docs(rows).repartition(5)).collect()
    want = {}
    for i, t in rows:
        want.setdefault(t, []).append(i)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == sorted((i, max(want[t]), len(want[t]), i == max(want[t])) for i, t in rows)


def test_blocks_stay_long_however_many_rows_there_are():
    for total in (10**6, 10**9, 5 * 10**10):
        bits, senders = exchange.shares(total)
        assert total / senders / 2**bits >= exchange.BLOCK_ROWS / 2 and total / 2**bits <= exchange.OWNER_ROWS * 2
