"""Byte-level BPE by merge ranks: encoding and decoding with DuckDB queries over each partition.

A rank file gives each token's bytes an id; the lower the id, the earlier its merge. The merge table holds every
split of a token into two tokens. A task cuts texts into words by the pattern and encodes each distinct new word of a
group of documents once: rows (word, pos, token) join the merge table with their right neighbour, and a recursive
query contracts each word's leftmost pair of least rank until no pair is left. Decoding joins the tokens of a group to
the vocabulary and concatenates their bytes by an ordered aggregation.

Contracting all places of the least rank at once would be the same as one after the other unless the new token starts
or ends a pair of still lower rank. Tokens without such a pair are marked in the merge table and contracted everywhere
in one step; for the others a step takes the leftmost place only.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_CHARS = 2_000_000
GROUP_TOKENS = 400_000
HELD = 300_000  # words in each half of what a Python worker remembers
HELD_CHARS = 64
LONG = 64  # bytes; longer words are contracted at several places in one step
OTHER, LETTER, NUMBER = "", "é", "²"  # stand for characters whose class the two engines see differently


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids, from lines of base64 and a number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """(lhs, rhs, merged, everywhere, apart): all splits of tokens into two tokens.

    `everywhere`: no pair that has the merged token as a side has a lower rank. `apart`: no token is on the right in
    one split of the merged token and on the left in another, so two places of the merge never share a token.
    """
    rows = []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                rows.append((a, b, rank))
    held_back = {side for a, b, merged in rows for side in (a, b) if merged < side}
    left, right = {(a, merged) for a, _, merged in rows}, {(b, merged) for _, b, merged in rows}
    shared = {merged for _, merged in left & right}
    lhs, rhs, merged = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table(
        {
            "lhs": pa.array(lhs, pa.int32()),
            "rhs": pa.array(rhs, pa.int32()),
            "merged": pa.array(merged, pa.int32()),
            "everywhere": pa.array([x not in held_back for x in merged], pa.bool_()),
            "apart": pa.array([x not in shared for x in merged], pa.bool_()),
        }
    )


# A row's key is its word and the byte it begins at, so the row to its right begins at key + size. A step joins every
# row to its right neighbour and the merge table and keeps, for each word, the least rank with the first place it
# stands at, both in one number (`pair`: the rank, then the byte at which the right side begins). The row with that
# number takes the merged token and the row that begins at that byte goes.
ENCODE = """
WITH RECURSIVE steps(key, token, size, done) AS (
  SELECT key, token, 1::BIGINT, false FROM symbols
  UNION ALL
  (WITH live AS MATERIALIZED (SELECT key, token, size FROM steps WHERE NOT done),
   pairs AS MATERIALIZED (
     SELECT l.key, l.key >> 32 AS word, l.token, l.size, r.size AS more,
            (m.merged::BIGINT << 32) + (r.key & 4294967295) AS pair
     FROM live l LEFT JOIN live r ON r.key = l.key + l.size LEFT JOIN merges m ON m.lhs = l.token AND m.rhs = r.token),
   best AS (SELECT word, min(pair) AS pair FROM pairs GROUP BY word)
   SELECT p.key, CASE WHEN p.pair = b.pair THEN b.pair >> 32 ELSE p.token END,
          CASE WHEN p.pair = b.pair THEN p.size + p.more ELSE p.size END, b.pair IS NULL
   FROM pairs p JOIN best b ON b.word = p.word
   WHERE b.pair IS NULL OR (p.key & 4294967295) <> (b.pair & 4294967295)))
SELECT key, token FROM steps WHERE done ORDER BY key
"""

# The same for long words, with fewer steps: all places of the least merge are taken where that cannot matter, else the
# first. Of places that overlap, every second is taken.
ENCODE_LONG = """
WITH RECURSIVE steps(key, token, size, done) AS (
  SELECT key, token, 1::BIGINT, false FROM symbols
  UNION ALL
  (WITH live AS MATERIALIZED (SELECT key, token, size FROM steps WHERE NOT done),
   pairs AS MATERIALIZED (
     SELECT l.key, l.key >> 32 AS word, l.token, l.size, r.size AS more, m.merged, m.everywhere, m.apart
     FROM live l LEFT JOIN live r ON r.key = l.key + l.size LEFT JOIN merges m ON m.lhs = l.token AND m.rhs = r.token),
   best AS MATERIALIZED (
     SELECT word, min(merged) AS merged, arg_min(key, (merged::BIGINT << 32) + (key & 4294967295)) AS first
     FROM pairs GROUP BY word),
   hits AS MATERIALIZED (
     SELECT p.word, p.key, p.size, p.apart OR NOT p.everywhere AS alone
     FROM pairs p JOIN best b ON b.word = p.word AND b.merged = p.merged WHERE p.everywhere OR p.key = b.first),
   runs AS (
     SELECT *, sum(fresh) OVER (PARTITION BY word ORDER BY key) AS run
     FROM (SELECT word, key,
                  CASE WHEN key = lag(key + size) OVER (PARTITION BY word ORDER BY key) THEN 0 ELSE 1 END AS fresh
           FROM hits WHERE NOT alone)),
   taken AS MATERIALIZED (
     SELECT key FROM hits WHERE alone
     UNION ALL
     SELECT key FROM (SELECT key, row_number() OVER (PARTITION BY word, run ORDER BY key) AS nth FROM runs)
     WHERE nth % 2 = 1),
   gone AS (SELECT p.key + p.size AS key FROM pairs p JOIN taken t ON t.key = p.key)
   SELECT p.key, CASE WHEN t.key IS NULL THEN p.token ELSE p.merged END,
          CASE WHEN t.key IS NULL THEN p.size ELSE p.size + p.more END, b.merged IS NULL
   FROM pairs p JOIN best b ON b.word = p.word LEFT JOIN taken t ON t.key = p.key
   WHERE NOT EXISTS (FROM gone g WHERE g.key = p.key)))
SELECT key, token FROM steps WHERE done ORDER BY key
"""

# The database has one thread, so rows reach the aggregate in the order of the subquery. A list with an id that no
# token has is null.
DECODE = """
SELECT doc, CASE WHEN count(*) = count(hex) THEN string_agg(hex, '') END AS hex
FROM (SELECT t.doc, v.hex FROM tokens t LEFT JOIN vocabulary v USING (id) ORDER BY t.doc, t.place)
GROUP BY doc
"""


class Decoder:
    """A vocabulary in a DuckDB database in memory."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import duckdb

        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
        self._keep("vocabulary", pa.table({"hex": [x.hex().upper() for x in ranks], "id": pa.array(ranks.values(), pa.int32())}))

    def _keep(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _ask(self, name: str, rows: pa.Table, query: str) -> pa.Table:
        self.db.register(name, rows)
        found = self.db.sql(query).to_arrow_table()
        self.db.unregister(name)
        return found

    def decode(self, lists: pa.ListArray) -> list[bytes | None]:
        """Bytes of each list of ids; a null or empty list has none."""
        import pyarrow.compute as pc

        ids = lists.flatten()
        given = pa.table({"doc": pc.list_parent_indices(lists), "place": np.arange(len(ids)), "id": ids})
        found = self._ask("tokens", given, DECODE)
        texts: list[bytes | None] = [b""] * len(lists)
        for doc, data in zip(found.column("doc").to_pylist(), found.column("hex").to_pylist(), strict=True):
            texts[doc] = None if data is None else bytes.fromhex(data)
        return texts


class Encoder(Decoder):
    """A vocabulary with its merge table, and the words encoded so far."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__(ranks)
        self.ranks, self.new, self.old = ranks, {}, {}
        self.single = np.array([ranks.get(bytes([x]), -1) for x in range(256)], np.int64)  # tokens of one byte
        self._keep("merges", merge_table(ranks))

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Little-endian ids of each word. A word that is a token is that token, whatever the merges say."""
        codes = [self.ranks.get(x) for x in words]
        codes = [None if x is None else x.to_bytes(4, "little") for x in codes]
        rest = [i for i, x in enumerate(codes) if x is None and words[i]]
        for query, chosen in (
            (ENCODE, [i for i in rest if len(words[i]) <= LONG]),
            (ENCODE_LONG, [i for i in rest if len(words[i]) > LONG]),
        ):
            if not chosen:
                continue
            data = np.frombuffer(b"".join(words[i] for i in chosen), np.uint8)
            sizes = np.array([len(words[i]) for i in chosen])
            place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            key = (np.repeat(np.arange(len(chosen)), sizes) << 32) + place
            found = self._ask("symbols", pa.table({"key": key, "token": self.single[data]}), query)
            ids = found.column("token").to_numpy().astype("<i4").tobytes()
            counts = np.bincount(found.column("key").to_numpy() >> 32, minlength=len(chosen))
            ends = 4 * np.cumsum(counts)
            for i, b, n in zip(chosen, ends.tolist(), counts.tolist(), strict=True):
                codes[i] = ids[b - 4 * n : b]
        return [x or b"" for x in codes]

    def codes(self, groups: list[list[str]]) -> list[bytes]:
        """Little-endian ids of each list of words. Words are remembered; those not used of late are dropped."""
        used = {x: self.new.get(x) or self.old.get(x) for x in {x for own in groups for x in own}}
        unknown = [word for word, code in used.items() if code is None]
        used.update(zip(unknown, self.encode([x.encode() for x in unknown]), strict=True))
        if len(self.new) + len(used) > HELD:
            self.new, self.old = {}, self.new
        self.new.update((word, code) for word, code in used.items() if len(word) <= HELD_CHARS)
        return [b"".join(map(used.__getitem__, own)) for own in groups]


class Words:
    """Cuts texts into the matches of a pattern, with tiktoken's letters and numbers.

    `regex` may know another Unicode version. Characters are classed once by tiktoken's own engine; those that differ
    are replaced, one for one, before the pattern is applied, and words are sliced from the text by their lengths.
    """

    def __init__(self, pattern: str) -> None:
        import regex
        import tiktoken

        self.pattern = regex.compile(pattern)
        self.classes = [regex.compile(x) for x in (r"\p{L}", r"\p{N}")]
        single = {bytes([i]): i for i in range(256)}
        self.engines = [
            tiktoken.Encoding("class", pat_str=x.pattern, mergeable_ranks=single, special_tokens={}) for x in self.classes
        ]
        self.known: set[str] = set(map(chr, range(128)))
        self.other: dict[int, str] = {}

    def of(self, text: str) -> list[str]:
        if text.isascii():
            return self.pattern.findall(text)
        new = set(text) - self.known
        if new:
            self._classify("".join(new))
        plain = text.translate(self.other) if self.other else text
        if plain == text:
            return self.pattern.findall(text)
        return [text[x.start() : x.end()] for x in self.pattern.finditer(plain)]

    def _classify(self, chars: str) -> None:
        theirs = [set(bytes(x.encode_ordinary(chars)).decode()) for x in self.engines]
        ours = [set(x.findall(chars)) for x in self.classes]
        for char in (theirs[0] ^ ours[0]) | (theirs[1] ^ ours[1]):
            self.other[ord(char)] = LETTER if char in theirs[0] else NUMBER if char in theirs[1] else OTHER
        self.known.update(chars)


@cache
def encoder(path: str) -> Encoder:
    """One for each rank file and Python worker."""
    return Encoder(read_ranks(path))


@cache
def decoder(path: str) -> Decoder:
    return Decoder(read_ranks(path))


@cache
def cutter(pattern: str) -> Words:
    return Words(pattern)


def _encoder(path: str, pattern: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, words = encoder(path), cutter(pattern)
        for batch in batches:
            codes, group, chars = [], [], 0
            for text in batch.column(batch.num_columns - 1).to_pylist():
                group.append(words.of(text or ""))
                chars += len(text or "")
                if chars >= GROUP_CHARS:
                    codes += books.codes(group)
                    group, chars = [], 0
            codes += books.codes(group)
            edges = array("i", [0])
            for code in codes:
                edges.append(edges[-1] + len(code) // 4)
            ids = pa.Array.from_buffers(pa.int32(), edges[-1], [None, pa.py_buffer(b"".join(codes))])
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*batch.schema.names[:-1], "ids"])

    return encode


def encode(docs: DataFrame, rank_path: str, pattern: str, *keep: str) -> DataFrame:
    """The columns `keep` and `ids` (array of int): the tokens of `text` of every row, each word by itself.

    Null and empty texts have no ids. Repeated rows and repeated or null ids are encoded row by row; columns that are
    not kept are ignored, so their names cannot clash; an empty table gives an empty result. A text may be of any
    length; a word of n bytes takes at most n steps, one for each merge rank that occurs in it if those merges may be
    contracted everywhere at once.
    """
    rows = docs.select(*[F.col(x) for x in keep], F.col("text"))
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema.fields[:-1])
    return rows.mapInArrow(_encoder(rank_path, pattern), f"{schema}, ids array<int>" if keep else "ids array<int>")


def _decoder(path: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = decoder(path)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            sizes, texts, first, count = lists.value_lengths().to_pylist(), [], 0, 0
            for i, size in enumerate(sizes):
                count += size or 0
                if count >= GROUP_TOKENS:
                    texts += books.decode(lists.slice(first, i + 1 - first))
                    first, count = i + 1, 0
            texts += books.decode(lists.slice(first))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "bytes"])

    return decode


def decode(encoded: DataFrame, rank_path: str) -> DataFrame:
    """`encoded` (any columns and `ids`) with the decoded `bytes` (binary) of every row.

    Null and empty lists give no bytes; a list with an id that no token has gives null. A column named `bytes` is
    replaced.
    """
    rows = encoded.select(*[F.col(x) for x in encoded.columns if x not in ("ids", "bytes")], "ids")
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema.fields)
    return rows.mapInArrow(_decoder(rank_path), f"{schema}, bytes binary")
