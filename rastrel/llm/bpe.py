"""Byte-level BPE encoding and decoding by recursive queries of an embedded DuckDB in each partition.

Encoding: a piece of text starts as one row for each byte, (piece, pos, tok). A recursive query
joins neighbouring rows with the merge table, contracts each piece's leftmost pair of minimum rank,
and ends when no pair is in the table. Decoding: token rows join the vocabulary, and an ordered
aggregation puts the bytes together. Pieces are those that the vocabulary's split pattern makes; a
piece that is a token as a whole is that token, as in the tiktoken library. Each task keeps the
pieces that it has met in a cache of bounded size, so a word is seldom encoded twice.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrel.llm.common import prepare, release

#: Bytes of pieces in one recursive query; pieces beyond LONG bytes go through LONG_SQL.
QUERY_BYTES, LONG = 400_000, 200
#: The cache of a worker is emptied beyond so many pieces of text.
CACHE_PIECES = 250_000
#: White space at an end or beside other white space, \x1c-\x1f included; as RE2 writes it.
UNEVEN = r"(^[\s\x0b\x1c-\x1f\x85\p{Z}])|([\s\x0b\x1c-\x1f\x85\p{Z}]$)|([\s\x0b\x1c-\x1f\x85\p{Z}]{2})|(^$)"
#: Documents are taken up to so many bytes at a time.
BATCH_BYTES = 4_000_000
#: Put between strings to split them in one go.
BREAK = "\u2028"

# ranked: the merged token above the row's place, so that the least is the leftmost of minimum rank.
# Rows keep their order (one thread, insertion order preserved), so lead() and lag() need no sort.
ENCODE_SQL = """
WITH RECURSIVE st(step, piece, pos, tok) AS (
  SELECT 0, piece, pos, tok FROM start_rows
  UNION ALL
  SELECT step + 1, piece, pos, CASE WHEN ranked = best THEN (best >> 32)::INTEGER ELSE tok END
  FROM (WITH pairs AS MATERIALIZED (
          SELECT p.*, m.ranked | p.pos AS ranked
          FROM (SELECT *, CASE WHEN lead(piece) OVER () = piece THEN (tok::BIGINT << 32) | lead(tok) OVER () END AS pair FROM st) p
          LEFT JOIN merges m ON m.pair = p.pair)
        SELECT x.*, best
        FROM (SELECT *, lag(ranked) OVER () AS before FROM pairs) x
        JOIN (SELECT piece, min(ranked) AS best FROM pairs WHERE ranked IS NOT NULL GROUP BY piece) y ON x.piece = y.piece)
  WHERE before IS NULL OR before <> best
), ends AS (SELECT piece, max(step) AS step FROM st GROUP BY piece)
SELECT piece, list(tok ORDER BY pos) AS toks FROM st JOIN ends USING (piece, step) GROUP BY piece ORDER BY piece
"""
# One long piece, LIMIT steps at a time. All occurrences of the pair of minimum rank go in one step where
# no pair with the merged token ranks lower (lasting), which then can't be overtaken; else the leftmost alone.
# In a run such as aaaa every second row begins a pair.
LONG_SQL = """
WITH RECURSIVE st(step, pos, tok, more) AS (
  SELECT 0, pos, tok, true FROM start_rows
  UNION ALL
  SELECT step + 1, pos, CASE WHEN taken THEN merged ELSE tok END, true
  FROM (SELECT *, coalesce(lag(taken) OVER (ORDER BY pos), false) AS gone
        FROM (SELECT *, hit AND CASE WHEN lasting THEN (row_number() OVER (PARTITION BY run ORDER BY pos)) % 2 = 1 ELSE pos = first_pos END AS taken
              FROM (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) * 2 + hit::INTEGER AS run,
                           min(CASE WHEN hit THEN pos END) OVER () AS first_pos
                    FROM (SELECT *, coalesce(merged = min(merged) OVER (), false) AS hit
                          FROM (SELECT p.*, (m.ranked >> 32)::INTEGER AS merged, m.lasting
                                FROM (SELECT *, (tok::BIGINT << 32) | lead(tok) OVER (ORDER BY pos) AS pair FROM st WHERE step < {limit}) p
                                LEFT JOIN merges m ON m.pair = p.pair)))
              WHERE first_pos IS NOT NULL))
  WHERE NOT gone
), ends AS (SELECT max(step) AS step FROM st)
SELECT step, pos, tok FROM st JOIN ends USING (step) ORDER BY pos
"""
DECODE_SQL = """
SELECT piece, string_agg(hex, '' ORDER BY pos) AS hex FROM token_rows JOIN vocabulary USING (tok) GROUP BY piece ORDER BY piece
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """One vocabulary and its DuckDB connection."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        # the library's white space is Unicode's, without \x1c-\x1f
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"), regex.V1)
        left, right, merged = [], [], []
        lowest: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
                    for x in (a, b):
                        lowest[x] = min(rank, lowest.get(x, rank))
        self.octets = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "preserve_insertion_order": True})
        pairs = (np.array(left, dtype=np.int64) << 32) | np.array(right, dtype=np.int64)
        lasting = np.array([lowest.get(m, m + 1) > m for m in merged], dtype=bool)
        self._fill("merges", pa.table({"pair": pairs, "ranked": np.array(merged, dtype=np.int64) << 32, "lasting": lasting}))
        self._fill("vocabulary", pa.table({"tok": pa.array(list(self.ranks.values()), pa.int32()), "hex": [t.hex() for t in self.ranks]}))
        self.forget()

    def _fill(self, name: str, rows: pa.Table) -> None:
        self.db.register("filling", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM filling")
        self.db.unregister("filling")

    def forget(self) -> None:
        """Empty the cache: piece -> number, and for each number its ids as bytes and what they decode to."""
        self.known: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.decoded: list[bytes] = []

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The tokens of each piece; a piece is not split any further."""
        out: list[np.ndarray | None] = [np.array([self.ranks[p]], dtype="<u4") if p in self.ranks else None for p in pieces]
        todo = [i for i, x in enumerate(out) if x is None]
        for i in [i for i in todo if len(pieces[i]) > LONG]:
            out[i] = self._encode_long(pieces[i])
        todo = [i for i in todo if len(pieces[i]) <= LONG]
        sizes = np.cumsum([len(pieces[i]) for i in todo])
        cuts = np.searchsorted(sizes, np.arange(QUERY_BYTES, sizes[-1] + QUERY_BYTES, QUERY_BYTES), "left") if todo else []
        start = 0
        for cut in dict.fromkeys(int(c) + 1 for c in cuts):
            own = todo[start:cut]
            start = cut
            if not own:
                continue
            lengths = np.array([len(pieces[i]) for i in own])
            octets = np.frombuffer(b"".join(pieces[i] for i in own), dtype=np.uint8)
            pos = np.arange(len(octets)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            rows = {"piece": np.repeat(np.arange(len(own), dtype=np.int32), lengths), "pos": pos.astype(np.int32), "tok": self.octets[octets]}
            self.db.register("start_rows", pa.table(rows))
            toks = self.db.sql(ENCODE_SQL).to_arrow_table().column("toks").combine_chunks()
            flat, offsets = toks.values.to_numpy(zero_copy_only=False).astype("<u4"), toks.offsets.to_numpy()
            for k, i in enumerate(own):
                out[i] = flat[offsets[k] : offsets[k + 1]]
        return out

    def _encode_long(self, piece: bytes) -> np.ndarray:
        limit = max(8, 2_000_000 // len(piece))
        toks = self.octets[np.frombuffer(piece, dtype=np.uint8)]
        while True:
            self.db.register("start_rows", pa.table({"pos": np.arange(len(toks), dtype=np.int32), "tok": toks}))
            rows = self.db.execute(LONG_SQL.format(limit=limit)).fetchnumpy()
            toks = np.asarray(rows["tok"], dtype=np.int32)
            if rows["step"][0] < limit:
                return toks.astype("<u4")

    def decode_rows(self, piece: np.ndarray, tok: np.ndarray) -> list[bytes]:
        """The bytes of pieces 0, 1, ..., each with at least one token; tokens in order."""
        if not len(tok):
            return []
        self.db.register("token_rows", pa.table({"piece": piece.astype(np.int64), "pos": np.arange(len(tok), dtype=np.int64), "tok": tok.astype(np.int32)}))
        return [bytes.fromhex(x) for x in self.db.sql(DECODE_SQL).to_arrow_table().column("hex").to_pylist()]

    def _learn(self, pieces: list[str]) -> None:
        toks = self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in pieces])
        for a in range(0, len(toks), 100_000):
            part = toks[a : a + 100_000]
            self.decoded += self.decode_rows(np.repeat(np.arange(len(part)), [len(t) for t in part]), np.concatenate(part))
            self.ids += [t.tobytes() for t in part]
        self.known.update(zip(pieces, range(len(self.known), len(self.ids)), strict=True))

    def round_trip(self, texts: pa.Array) -> Iterator[tuple[bytes, bytes]]:
        """For each text its ids, as little-endian unsigned 32-bit integers, and the bytes that they decode to.

        A text is cut at its spaces, equal parts are looked at once, and the results are put together
        by part numbers. That is right where every space stands between two other characters, as no
        piece goes on over such a space; a text with another space is one part.
        """
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        even = pc.invert(pc.match_substring_regex(texts, UNEVEN))
        lists = pc.split_pattern(pc.if_else(even, texts, ""), " ")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        parts = lists.flatten().dictionary_encode()
        first = np.zeros(len(parts), dtype=np.int64)
        first[offsets[:-1]] = 1
        # a part at a text's start lacks the space that stands before the others
        kinds, codes = np.unique(parts.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + first, return_inverse=True)
        space = pa.array(np.where(kinds & 1, "", " ").tolist(), pa.large_string())
        distinct = pa.concat_arrays([pc.binary_join_element_wise(space, parts.dictionary.take(pa.array(kinds >> 1)), pa.scalar("", pa.large_string())), texts.filter(pc.invert(even))])
        numbers, ends = self._pieces(distinct, len(kinds))
        whole = np.arange(len(distinct) - len(kinds)) + len(kinds)  # the uneven texts
        at = iter(whole.tolist())
        results = []
        for table in (self.ids, self.decoded):
            own, index = np.unique(numbers, return_inverse=True)
            flat = pa.array([table[n] for n in own.tolist()], pa.large_binary()).take(pa.array(index))
            joined = _regroup(flat, np.concatenate([[0], ends]))
            results.append((joined, _regroup(joined.take(pa.array(codes)), offsets)))
        for i, fine in enumerate(even.to_pylist()):
            k = None if fine else next(at)
            yield tuple(r[1][i].as_py() if fine else r[0][k].as_py() for r in results)

    def _pieces(self, distinct: pa.Array, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The cache's numbers of all pieces of the strings, one string after the other, and where each string's end.

        The first `parts` strings have no white space at an end but for one leading space; a break, as
        white space, parts them from each other, so that one call splits them all.
        """
        sizes = np.zeros(len(distinct), dtype=np.int64)
        full = np.flatnonzero(pc.binary_length(distinct).to_numpy(zero_copy_only=False))
        if pc.any(pc.match_substring(distinct, BREAK)).as_py():
            parts = 0
        together, alone = full[full < parts], full[full >= parts]
        joined = BREAK.join(distinct.take(pa.array(together)).to_pylist())
        flat = pa.array(self.split.findall(joined), pa.large_string())
        if len(together):
            breaks = pc.equal(flat, BREAK).to_numpy(zero_copy_only=False)
            at = np.append(np.flatnonzero(breaks), len(flat))
            sizes[together] = np.diff(np.concatenate([[-1], at])) - 1
            flat = flat.filter(pa.array(~breaks))
        own = [self.split.findall(x) for x in distinct.take(pa.array(alone)).to_pylist()]
        sizes[alone] = [len(x) for x in own]
        flat = pa.concat_arrays([flat, pa.array([p for x in own for p in x], pa.large_string())])
        ends = np.cumsum(sizes)
        pieces = flat.dictionary_encode()
        names = pieces.dictionary.to_pylist()
        if len(self.known) > CACHE_PIECES:
            self.forget()
            release()
        new = sorted(p for p in names if p not in self.known)
        if new:
            self._learn(new)
        numbers = np.fromiter(map(self.known.__getitem__, names), dtype=np.int64, count=len(names))
        return numbers[pieces.indices.to_numpy(zero_copy_only=False)] if len(names) else numbers, ends

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(own, dtype="<u4") for own, _ in self.round_trip(pa.array(texts, pa.string()))]


def _regroup(values: pa.LargeBinaryArray, bounds: np.ndarray) -> pa.LargeBinaryArray:
    """The values between each two bounds as one."""
    at = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, dtype=np.int64)
    data = values.buffers()[2] if len(values) else None
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(at[bounds])), data or pa.py_buffer(b"")])


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """This process's codec, made once."""
    if (path, pattern) not in _CODECS:
        _CODECS.clear()
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _bounded(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts of up to BATCH_BYTES in all: the number of the first, and how many."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + BATCH_BYTES)))
        yield start, min(end, len(texts)) - start
        start = end


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """A row for each of docs: doc_id, n_tokens, token_ids (little-endian unsigned 32-bit integers in a binary), and the digests.

    with_ids=False leaves the ids out. ids_sha256 and decoded_sha256 are of the ids and of the bytes that they decode to. Null and empty
    texts have no tokens. Repeated rows stay repeated, null ids stay null, an empty table gives no
    rows, and other columns are not read. Whole texts are encoded, at any length.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for start, n in _bounded(batch.column(1)):
                ids, counts, a, b = [], [], [], []
                for own, back in c.round_trip(batch.column(1).slice(start, n)):
                    ids.append(own if with_ids else b"")
                    counts.append(len(own) // 4)
                    a.append(hashlib.sha256(own).hexdigest())
                    b.append(hashlib.sha256(back).hexdigest())
                yield pa.record_batch(
                    [batch.column(0).slice(start, n), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                    names=["doc_id", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256"],
                )
        c.forget()  # the next task may be another operator's
        release()

    schema = "doc_id long, n_tokens long, token_ids binary, ids_sha256 string, decoded_sha256 string"
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out if with_ids else out.drop("token_ids")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) from (doc_id, token_ids); bytes that are not UTF-8 become U+FFFD, null ids of tokens an empty text."""
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            out = [""] * len(batch)
            ids = [np.frombuffer(x.as_py() or b"", dtype="<u4") for x in batch.column(1)]
            full = [i for i, x in enumerate(ids) if len(x)]
            while full:
                n = max(1, int(np.searchsorted(np.cumsum([len(ids[i]) for i in full]), 2_000_000)))
                part, full = full[:n], full[n:]
                lengths = [len(ids[i]) for i in part]
                for i, back in zip(part, c.decode_rows(np.repeat(np.arange(len(part)), lengths), np.concatenate([ids[i] for i in part])), strict=True):
                    out[i] = back.decode("utf-8", "replace")
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")
