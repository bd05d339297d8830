"""Merges of byte-level BPE against a plain loop."""

import numpy as np

from vicinity.llm import bpe


def _plain(piece, ranks):
    """Byte pairs by the book: the leftmost pair of the smallest rank, again and again."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [bytes([b]) for b in piece]
    while True:
        pairs = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, k = min(pairs)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_merges_of_any_order_of_ranks_without_sorting_in_a_round():
    rng = np.random.default_rng(6)
    word = lambda most: bytes(rng.integers(97, 100, rng.integers(2, most)).astype(np.uint8))
    longer = sorted({word(6) for _ in range(60)})
    tokens = [bytes([b]) for b in range(256)] + [longer[k] for k in rng.permutation(len(longer))]
    ranks = {t: 3 * k + 1 for k, t in enumerate(tokens)}
    pairs = [(ranks[t[:k]], ranks[t[k:]], m) for t, m in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    tables = bpe.Tables(bpe.Vocabulary(ranks, np.array(pairs, np.int32).T))
    pieces = [word(40) for _ in range(3000)] + [b"z", b"ab", "ü".encode(), b"abc" * 300]
    piece, token = tables.encode(pieces)
    edge = np.searchsorted(piece, np.arange(len(pieces) + 1))
    assert [token[a:b].tolist() for a, b in zip(edge[:-1], edge[1:])] == [_plain(p, ranks) for p in pieces]
    assert tables.decode(piece, token, len(pieces)) == pieces
    tables.con.execute("CREATE TABLE pieces (piece BIGINT, tokens INTEGER[], pairs INTEGER[], pos BIGINT, token INTEGER)")
    plan = tables.con.execute("EXPLAIN " + bpe._ENCODE).fetchall()[-1][1].upper()
    tables.con.close()
    assert "WINDOW" not in plan and "ORDER" not in plan and "GROUP" not in plan
