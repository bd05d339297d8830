"""Byte-level BPE by recursive DuckDB queries inside each partition.

A text is cut by the tokenizer's pattern, and every cut is encoded on its own, so a task encodes each distinct piece
once. A piece becomes a row with the lists of its tokens and of the ranks of its pairs. The recursive query contracts
the leftmost pair of the smallest rank in each piece, joins the new token and its two neighbours with the merge table,
and goes on until a piece has no pair left. An aggregation in order of the positions joins the tokens' bytes again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small

#: Pieces that a worker remembers, pieces in one query, and the largest vocabulary file that is sent to the tasks.
REMEMBERED, AT_ONCE, LARGEST = 240_000, 32_000, 64 << 20

#: Stands for a pair that is no token.
_NONE = (1 << 31) - 1

_ENCODE = f"""
WITH RECURSIVE state AS (
    SELECT piece, tokens, pairs, list_min(pairs) AS best FROM pieces
    UNION ALL
    (WITH chosen AS (
        SELECT *, list_position(pairs, best) AS i FROM state WHERE best < {_NONE}
    ), contracted AS (
        SELECT c.piece, c.tokens[1:i - 1] || [c.best] || c.tokens[i + 2:] AS tokens,
            CASE WHEN i > 1 THEN c.pairs[1:i - 2] || [coalesce(x.merged, {_NONE}), coalesce(y.merged, {_NONE})] || c.pairs[i + 2:]
                ELSE [coalesce(y.merged, {_NONE})] || c.pairs[3:] END AS pairs
        FROM chosen c LEFT JOIN merges x ON x.pair = (c.tokens[i - 1]::BIGINT << 32) + c.best
        LEFT JOIN merges y ON y.pair = (c.best::BIGINT << 32) + c.tokens[i + 2]
    )
    SELECT piece, tokens, pairs, list_min(pairs) AS best FROM contracted)
)
SELECT piece, tokens FROM state WHERE best = {_NONE}
"""
_DECODE = "SELECT t.piece, string_agg(v.hex, '' ORDER BY t.pos) AS hex FROM tokens t JOIN vocabulary v ON v.token = t.token GROUP BY t.piece ORDER BY t.piece"


@dataclass
class Vocabulary:
    """Ranks of the tokens, and every way to make a token of two others; what is sent to the tasks."""

    ranks: dict[bytes, int]
    merges: np.ndarray

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        content = Path(path).read_bytes()
        if len(content) > LARGEST:
            raise ValueError("the vocabulary is too large to be sent to every task")
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
        pairs = [(ranks[t[:k]], ranks[t[k:]], m) for t, m in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        return cls(ranks, np.array(pairs, np.int32).reshape(-1, 3).T)


class Tables:
    """A vocabulary as DuckDB tables, for the time of a task."""

    #: Pieces with their tokens, those met in more than one batch, and those that don't decode to themselves. A worker
    #: process serves one task after the other and keeps them; ``owner`` tells vocabularies apart.
    known: dict[str, bytes] = {}
    met: set[str] = set()
    unlike: dict[str, bytes] = {}
    owner = None

    def __init__(self, vocabulary: Vocabulary, pattern: str | None = None):
        import duckdb

        owner = (pattern, len(vocabulary.ranks), int(vocabulary.merges.sum(dtype=np.int64)))
        if pattern is not None and Tables.owner != owner:
            Tables.known, Tables.met, Tables.unlike, Tables.owner = {}, set(), {}, owner
        self.ranks = vocabulary.ranks
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "200MB"})
        left, right, merged = vocabulary.merges
        merges = pa.table({"pair": (left.astype(np.int64) << 32) + right, "merged": merged})
        byte_of = np.full(max(self.ranks.values()) + 1, -1)
        byte_of[self.of_byte] = np.arange(256)
        two = (byte_of[left] >= 0) & (byte_of[right] >= 0)
        self.of_bytes = np.full((256, 256), _NONE, np.int32)
        self.of_bytes[byte_of[left[two]], byte_of[right[two]]] = merged[two]
        tokens = pa.table({"token": pa.array(list(self.ranks.values()), pa.int32()), "hex": [t.hex() for t in self.ranks]})
        for name, rows in (("merges", merges), ("vocabulary", tokens)):
            self.con.register("given", rows)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.con.unregister("given")

    def close(self) -> None:
        self.con.close()
        self.forget()

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the piece and token, in order. A piece that is a token stays one, as every encoder does it."""
        whole = [(k, self.ranks[p]) for k, p in enumerate(pieces) if p in self.ranks]
        rest = [k for k, p in enumerate(pieces) if p not in self.ranks and p]
        raw = np.frombuffer(b"".join(pieces[k] for k in rest), np.uint8)
        edge = np.cumsum([0, *(len(pieces[k]) for k in rest)])
        pairs = np.full(len(raw), _NONE, np.int32)
        pairs[:-1] = self.of_bytes[raw[:-1], raw[1:]]
        pairs[edge[1:] - 1] = _NONE
        lists = {k: pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(x)) for k, x in (("tokens", self.of_byte[raw]), ("pairs", pairs))}
        self.con.register("pieces", pa.table({"piece": np.array(rest, np.int64)} | lists))
        done = self.con.sql(_ENCODE).to_arrow_table().combine_chunks()
        self.con.unregister("pieces")
        lengths = pc.list_value_length(done["tokens"]).to_numpy()
        piece = np.concatenate([np.repeat(done["piece"].to_numpy(), lengths), np.array([k for k, _ in whole], np.int64)])
        token = np.concatenate([pc.list_flatten(done["tokens"]).to_numpy(), np.array([t for _, t in whole], np.int32)])
        order = np.argsort(piece, kind="stable")
        return piece[order], token[order].astype("<u4")

    def forget(self) -> None:
        """Keeps the pieces that were met again, unless these are too many as well."""
        if len(self.met) > REMEMBERED // 2:
            Tables.met = set()
        Tables.known = {p: self.known[p] for p in self.met}
        Tables.unlike = {p: d for p, d in self.unlike.items() if p in self.met}

    def decode(self, piece: np.ndarray, token: np.ndarray, n: int) -> list[bytes]:
        """The bytes of each of ``n`` runs of tokens that are given in order."""
        self.con.register("tokens", pa.table({"piece": piece, "pos": np.arange(len(piece)), "token": token.astype(np.int32)}))
        done = self.con.sql(_DECODE).to_arrow_table()
        self.con.unregister("tokens")
        out = [b""] * n
        for k, text in zip(done["piece"].to_pylist(), done["hex"].to_pylist()):
            out[k] = bytes.fromhex(text)
        return out


def _encoder(shared, pattern: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        tables, cut = Tables(shared.value, pattern), regex.compile(pattern)
        for batch in small(batches, "_text", 2 << 20):
            texts = [cut.findall(t or "") for t in batch["_text"].to_pylist()]
            new = set(chain.from_iterable(texts))
            tables.met.update(new.intersection(tables.known))
            if len(tables.known) + len(new) > REMEMBERED:
                tables.forget()
            ids, back = tables.known, tables.unlike
            new = list(new.difference(ids))
            for at in range(0, len(new), AT_ONCE):
                some = [p.encode() for p in new[at : at + AT_ONCE]]
                piece, token = tables.encode(some)
                edge = np.searchsorted(piece, np.arange(len(some) + 1)) * 4
                raw = token.tobytes()
                ids.update((p, raw[a:b]) for p, a, b in zip(new[at : at + AT_ONCE], edge[:-1].tolist(), edge[1:].tolist()))
                decoded = tables.decode(piece, token, len(some))
                back.update((p.decode(), d) for p, d in zip(some, decoded) if p != d)
            tokens = [b"".join(map(ids.__getitem__, t)) for t in texts]
            if back:
                decoded = [b"".join(back.get(p) or p.encode() for p in t) for t in texts]
            else:
                decoded = ["".join(t).encode() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch["_id"], pa.array([len(t) // 4 for t in tokens], pa.int64()), pa.array(tokens, pa.binary()), pa.array(decoded, pa.binary())],
                names=["_id", "n_tokens", "token_ids", "decoded"],
            )
        tables.close()

    return read


def _decoder(shared):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(shared.value)
        for batch in small(batches, "_ids", 4 << 20):
            runs = [np.frombuffer(x or b"", "<u4") for x in batch["_ids"].to_pylist()]
            number = np.repeat(np.arange(len(runs)), [len(x) for x in runs])
            out = tables.decode(number, np.concatenate(runs), len(runs))
            yield pa.RecordBatch.from_arrays([batch["_id"], pa.array(out, pa.binary())], names=["_id", "decoded"])
        tables.close()

    return read


def _shared(docs: DataFrame, path: str):
    return docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, token_ids, decoded)``: ids as little-endian unsigned 32-bit integers, and the bytes they decode to.

    ``path`` is a rank file (base64 bytes and rank in each line), ``pattern`` cuts the text before the merges. There
    are no special tokens. A missing or empty text has no tokens; a missing id stays missing; repeated rows stay as
    they are; other columns aren't read. Memory is bounded by a batch of texts, or by one text if it is longer.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    result = rows.mapInArrow(_encoder(_shared(docs, path), pattern), f"_id {kind}, n_tokens long, token_ids binary, decoded binary")
    return result.withColumnRenamed("_id", id_col)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """``(doc_id, decoded)``: the bytes of any ids in the form that ``encode`` returns; missing ids decode to nothing."""
    kind = dict(tokens.dtypes)[id_col]
    rows = tokens.select(F.col(id_col).alias("_id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("_ids"))
    return rows.mapInArrow(_decoder(_shared(tokens, path)), f"_id {kind}, decoded binary").withColumnRenamed("_id", id_col)
