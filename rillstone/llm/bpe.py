"""Byte-level BPE of a whole corpus with a public tokenizer, by recursive queries in each partition."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The folder of the public tokenizers; it must be there on every executor.
FOLDER = "/opt/tokenizers"

#: Fixed value: how the vocabulary's makers cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: No word goes on from a character that isn't white space to one that is, so texts may be cut there.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = re.compile(rf"[{_WS}]*[^{_WS}]+|[{_WS}]+")

#: Bytes of a word for one line of token-position rows; longer words are put together from such parts.
PART = 64
#: Tokens on each side of a seam that are contracted anew, at first.
SEAM = 6
#: Bytes for one recursive query, characters of text worked on at once, bytes of words and pieces remembered.
QUERY_BYTES, TEXT_CHARS, REMEMBERED = 400_000, 16_000_000, 48_000_000

#: The tokens of some lines with the positions of their first byte and of the byte behind them, lines lying
#: one byte apart; each position is kept once, however many steps there are. A step contracts the pairs
#: of least rank of each line that still has one: all of them, but for those that overlap with one before,
#: and, where the merged token takes part in a merge of less rank, only the first. That is the same as
#: one by one from the left. A line's tokens are those of its last step.
CONTRACT = """
WITH RECURSIVE step(w, pos, ends, i, tok) USING KEY (pos) AS (
  SELECT w, pos, pos + 1, 0, tok FROM tokens
  UNION ALL
  (WITH pairs AS MATERIALIZED (
     SELECT a.w, a.pos, a.ends, b.ends AS far, a.i, a.tok, rank, merged, alone
     FROM step a LEFT JOIN step b ON b.pos = a.ends LEFT JOIN merges ON a.tok = l AND b.tok = r),
   best AS MATERIALIZED (SELECT w, min(rank << 32 | pos) AS least FROM pairs WHERE rank IS NOT NULL GROUP BY w),
   candidates AS MATERIALIZED (SELECT pos, ends, far, merged FROM pairs JOIN best USING (w) WHERE rank = least >> 32 AND (NOT alone OR pos = least & 4294967295)),
   chosen AS MATERIALIZED (SELECT * FROM candidates WHERE pos NOT IN (SELECT ends FROM candidates))
   SELECT p.w, p.pos, coalesce(c.far, p.ends), i + 1, coalesce(c.merged, tok)
   FROM pairs p SEMI JOIN best USING (w) LEFT JOIN chosen c ON c.pos = p.pos
   WHERE p.pos NOT IN (SELECT ends FROM chosen)))
SELECT w, list(tok ORDER BY pos) FROM step JOIN (SELECT w, max(i) AS i FROM step GROUP BY w) AS ended USING (w, i) GROUP BY w
"""


def byte_characters() -> list[str]:
    """How the vocabulary file writes each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (chr(256 + k) for k in range(256))
    return [chr(b) if b in plain else next(others) for b in range(256)]


class Encoder:
    """Word by word encoder with a memory of the pieces and words it has seen."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        written = byte_characters()
        self.of_byte = np.array([vocab[c] for c in written], np.int32)
        table = [(vocab[a], vocab[b], k, vocab[a + b]) for k, (a, b) in enumerate(pairs)]
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each token
        for token, k in vocab.items():
            self.sizes[k] = len(token)
        first: dict[int, int] = {}  # the least rank of a merge that the token takes part in
        for a, b, k, _ in table:
            first.setdefault(a, k)
            first.setdefault(b, k)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        cols = np.array(table, np.int64).reshape(-1, 4).T
        alone = pa.array([first.get(c, k) < k for _, _, k, c in table], pa.bool_())
        of_pairs = pa.table({"l": pa.array(cols[0], pa.int32()), "r": pa.array(cols[1], pa.int32()), "rank": cols[2], "merged": pa.array(cols[3], pa.int32()), "alone": alone})
        self.db.register("of_pairs", of_pairs)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM of_pairs")
        self.cut = regex.compile(WORDS)
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.held = 0

    def contracted(self, lines: list[bytes]) -> list[np.ndarray]:
        """The ids of each byte string, by recursive queries over some of them at a time."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(lines)
        size = 0
        numbered = [(size := size + len(b), i, b) for i, b in enumerate(lines)]
        for _, block in groupby(numbered, lambda x: x[0] // QUERY_BYTES):
            _, own, data = zip(*block, strict=True)
            lengths = np.array([len(b) for b in data])
            joined = self.of_byte[np.frombuffer(b"".join(data), np.uint8)]
            line = np.repeat(np.arange(len(own)), lengths)
            tokens = pa.table({"w": pa.array(line, pa.int32()), "pos": pa.array(np.arange(len(joined)) + line, pa.int64()), "tok": pa.array(joined, pa.int32())})
            self.db.register("tokens", tokens)
            found = self.db.sql(CONTRACT).to_arrow_table().combine_chunks()
            self.db.unregister("tokens")
            ids = found.column(1).combine_chunks() if isinstance(found.column(1), pa.ChunkedArray) else found.column(1)
            flat, offsets = ids.values.to_numpy(zero_copy_only=False).astype(np.int32), ids.offsets.to_numpy()
            for k, w in enumerate(found.column(0).to_pylist()):
                out[own[w]] = flat[offsets[k] : offsets[k + 1]]
        return out

    def joined(self, sides: list[tuple[np.ndarray, np.ndarray, bytes]]) -> list[np.ndarray]:
        """The ids of byte strings of which the ids of a left and a right part are known.

        Ids are those of a string if and only if each two neighbours are those of their own bytes, as the
        first merge over a border would also be made without what stands farther off. So only the
        tokens about the seam are contracted anew; if the outermost of them stay what they were, all others do.
        """
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(sides)
        todo = [(k, SEAM, SEAM) for k in range(len(sides))]
        while todo:
            lines = []
            for k, a, b in todo:
                left, right, raw = sides[k]
                middle = int(self.sizes[left].sum())
                lines.append(raw[middle - int(self.sizes[left[-a:]].sum()) : middle + int(self.sizes[right[:b]].sum())])
            again = []
            for (k, a, b), new in zip(todo, self.contracted(lines), strict=True):
                left, right, _ = sides[k]
                left_fits, right_fits = a >= len(left) or new[0] == left[-a], b >= len(right) or new[-1] == right[b - 1]
                if left_fits and right_fits:
                    out[k] = np.concatenate([left[:-a], new, right[b:]])
                else:
                    again.append((k, a if left_fits else 2 * a, b if right_fits else 2 * b))
            todo = again
        return out

    def contract(self, words: list[str]) -> None:
        """Put the ids of new words into self.words: parts of each are contracted, then joined two by two."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        parts = [[b[i : i + PART] for i in range(0, len(b), PART)] for b in raw]
        distinct = list({p for own in parts for p in own})
        ids = dict(zip(distinct, self.contracted(distinct), strict=True))
        lines = [[(ids[p], p) for p in own] for own in parts]
        while any(len(own) > 1 for own in lines):
            pairs = [(n, i) for n, own in enumerate(lines) for i in range(0, len(own) - 1, 2)]
            sides = [(lines[n][i][0], lines[n][i + 1][0], lines[n][i][1] + lines[n][i + 1][1]) for n, i in pairs]
            done = iter(zip(self.joined(sides), (raw for _, _, raw in sides), strict=True))
            lines = [[next(done) if i + 1 < len(own) else own[i] for i in range(0, len(own), 2)] for own in lines]
        for w, own in zip(words, lines, strict=True):
            self.words[w] = own[0][0].tobytes()
            self.held += len(self.words[w]) + len(w)

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of new pieces, white space and what follows it, into self.pieces."""
        if self.held > REMEMBERED:
            self.pieces.clear()
            self.words.clear()
            self.held = 0
        new = [p for p in pieces if p not in self.pieces]
        cuts = [self.cut.findall(p) for p in new]
        self.contract([w for w in {w for c in cuts for w in c} if w not in self.words])
        words = self.words
        for p, c in zip(new, cuts, strict=True):
            self.pieces[p] = b"".join([words[w] for w in c])
            self.held += len(self.pieces[p]) + len(p)

    def encode(self, texts: list[str | None]) -> Iterator[list[bytes]]:
        """The ids of the texts as 32-bit numbers, some texts at a time."""
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (size == 0 or size < TEXT_CHARS):
                size += len(texts[end] or "")
                end += 1
            cut = [_PIECES.findall(t) if t else [] for t in texts[at:end]]
            fresh: set[str] = set()
            for c in cut:
                fresh.update(c)
            self.learn(fresh)
            # pieces of this part may have been dropped only before it was learned
            known = self.pieces
            yield [b"".join([known[p] for p in c]) for c in cut]
            at = end


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(path)


def encoded(df: DataFrame, doc_id: Column, text: Column, path: str = f"{FOLDER}/byte_bpe_50k.json", lengths_only: bool = False) -> DataFrame:
    """The ids of every text: doc_id BIGINT, ids ARRAY<INT> (or n_tokens INT with lengths_only).

    No special tokens; strings that look like one are ordinary text. Each row of df gives one row, also
    where doc_id is NULL or occurs again. A NULL and an empty text have an empty list. Texts are never
    cut short. There is no shuffle. Other columns of df are ignored whatever their names.

    Each partition's distinct words are contracted in DuckDB by recursive queries over token-position
    rows and the merge table. Words of any length go the same way: in parts of 64 bytes, and what the
    seams between them change is contracted anew, so a query's memory is in proportion to its bytes.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            at = 0
            for part in e.encode(batch.column(1).to_pylist()):
                doc = batch.column(0).slice(at, len(part))
                at += len(part)
                sizes = np.array([len(b) // 4 for b in part], np.int64)
                if lengths_only:
                    yield pa.RecordBatch.from_arrays([doc, pa.array(sizes, pa.int32())], names=["doc_id", "n_tokens"])
                    continue
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(part), np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([doc, ids], names=["doc_id", "ids"])

    rows = df.select(doc_id.cast("bigint").alias("doc_id"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(encode, "doc_id bigint, n_tokens int" if lengths_only else "doc_id bigint, ids array<int>")


def decoded(df: DataFrame, doc_id: Column, ids: Column, path: str = f"{FOLDER}/byte_bpe_50k.json") -> DataFrame:
    """The texts of lists of ids: doc_id BIGINT, text STRING. A NULL list is an empty text; bytes that are no text become U+FFFD."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = {c: b for b, c in enumerate(byte_characters())}
        vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
        raw = {k: bytes(written[c] for c in token) for token, k in vocab.items() if all(c in written for c in token)}
        for b in batches:
            texts = [b"".join([raw[i] for i in own or ()]).decode("utf-8", "replace") for own in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select(doc_id.cast("bigint").alias("doc_id"), ids.alias("ids")).mapInArrow(decode, "doc_id bigint, text string")
