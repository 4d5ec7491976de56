"""Byte-level BPE encoding and decoding, merged by recursive DuckDB queries inside each task.

Every text is cut by the split pattern; the distinct words a task has not met before become token-position rows in an
in-memory DuckDB. The recursive query joins each adjacent pair of tokens to the merge table and contracts, in every
word, the leftmost pair of least rank, until no word has a pair left. Decoding is the other way round: (word, position)
rows are joined to the tokens' bytes and put together by an ordered aggregation. Words are remembered within bounds, so
a frequent word is merged and decoded once for a worker; what a word decodes to is stored only where it isn't the word.

A long word (an unbroken run of over `LONG` bytes; none in ordinary prose) is encoded in overlapping windows by the same
query, equal windows once. A row of tokens is the encoding of its bytes exactly if every two neighbours are what their
joined bytes are encoded to; so two windows are joined at a token boundary that both have and where the two tokens may meet.
Where there is none, as in runs of one sign whose tokens are longer than the overlap, a longer window goes on from the last
token that is certain. Work and memory grow with the length of a word, not with its square.

Defined results: a null or empty text has no tokens and decodes to nothing; special strings in a text are ordinary text;
very long texts and words are encoded whole; null ids are carried; repeated rows are encoded one by one; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_and_text, map_text, table

#: Longer words are encoded in windows of twice STEP bytes, one every STEP bytes; where two don't meet, in one of FAR bytes.
LONG, STEP, FAR = 256, 32, 512
#: Squared bytes of words in one recursive query, which keeps every turn: some 100 MB.
SQUARES = 4_000_000
#: Words in one recursive query, and words remembered in a worker before a new generation begins, which takes over what is still met.
CHUNK, REMEMBERED = 40_000, 250_000
#: Texts of a task that are cut and looked up together, in bytes.
TEXTS = 2 << 20

#: The key of a row is word << 12 | position, so the next token of a word has the next key. A turn gives each word that has a pair its
#: next state; a word that has none drops out, and its last state is its encoding.
ENCODE = """
WITH RECURSIVE step(turn, key, id) AS (
  SELECT 0, key, id FROM start
  UNION ALL
  SELECT * FROM (
    WITH best AS (
      SELECT a.key >> 12 AS word, min(merges.merged << 12 | (a.key & 4095)) AS least
      FROM step a JOIN step b ON b.key = a.key + 1 JOIN merges ON merges.pair = (a.id << 20 | b.id)
      GROUP BY a.key >> 12)
    SELECT turn + 1, key - CASE WHEN key & 4095 > least & 4095 THEN 1 ELSE 0 END, CASE WHEN key & 4095 = least & 4095 THEN least >> 12 ELSE id END
    FROM step JOIN best ON word = key >> 12
    WHERE key & 4095 <> (least & 4095) + 1))
SELECT key >> 12 AS word, key & 4095 AS pos, id
FROM step JOIN (SELECT key >> 12 AS word, max(turn) AS turn FROM step GROUP BY 1) last ON last.word = step.key >> 12 AND last.turn = step.turn
"""
#: Ids and bytes of each word, in order.
DECODE = "SELECT word, string_agg(id::VARCHAR, ' ' ORDER BY pos) AS ids, string_agg(hex, '' ORDER BY pos) AS hex FROM ({encoded}) JOIN vocabulary USING (id) GROUP BY word"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteBpe:
    """Encodes and decodes the words of texts. One for a worker and a rank file."""

    def __init__(self, path: str, pattern: str):
        import duckdb

        self.ranks = read_ranks(path)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.token = {r: t for t, r in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.met: dict[tuple[int, int], bool] = {}
        self.words = regex.compile(pattern).findall
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.otherwise: dict[str, bytes] = {}
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        merges = [(self.ranks[t[:i]] << 20 | self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self._table("merges", pa.table({"pair": pa.array([m[0] for m in merges], pa.int64()), "merged": pa.array([m[1] for m in merges], pa.int64())}))
        self._table("vocabulary", pa.table({"id": pa.array(self.ranks.values(), pa.int64()), "hex": [t.hex() for t in self.ranks]}))

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _batches(self, words: list[bytes]) -> Iterator[list[int]]:
        """Numbers of words that go into one recursive query."""
        part, squares = [], 0
        for i, w in enumerate(words):
            if part and squares + len(w) ** 2 > SQUARES:
                yield part
                part, squares = [], 0
            part.append(i)
            squares += len(w) ** 2
        if part:
            yield part

    def _start(self, words: list[bytes], part: list[int]) -> None:
        sizes = np.array([len(words[i]) for i in part])
        data = np.frombuffer(b"".join([words[i] for i in part]), np.uint8)
        word, pos = np.repeat(np.array(part), sizes), np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self._table("start", pa.table({"key": pa.array(word << 12 | pos), "id": pa.array(self.byte[data])}))

    def _encoded(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words of up to 4095 bytes."""
        out: list[list[int]] = [[]] * len(words)
        for part in self._batches(words):
            self._start(words, part)
            for i, ids in self.db.execute(f"SELECT word, list(id ORDER BY pos) FROM ({ENCODE}) GROUP BY word").fetchall():
                out[i] = ids
        return out

    def _meet(self, pairs: set[tuple[int, int]]) -> None:
        """Learns which tokens may stand side by side: those that their joined bytes are encoded to."""
        new = [p for p in pairs if p not in self.met]
        for p, ids in zip(new, self._encoded([self.token[a] + self.token[b] for a, b in new]), strict=True):
            self.met[p] = ids == list(p)

    def _may_meet(self, a: int, b: int) -> bool:
        self._meet({(a, b)})
        return self.met[a, b]

    def _long(self, raw: bytes) -> list[int]:
        """Ids of a word of any length. Tokens of which all neighbours may meet are the encoding of their bytes, whatever
        they were found in, so windows are encoded side by side and joined at boundaries that both have."""
        if len(self.met) > REMEMBERED:
            self.met.clear()
        starts = range(0, max(1, len(raw) - STEP), STEP)
        pieces = [raw[s : s + 2 * STEP] if s != starts[-1] else raw[s:] for s in starts]
        distinct = list(dict.fromkeys(pieces))
        ids_of = dict(zip(distinct, self._encoded(distinct), strict=True))
        found: dict[bytes, list[int]] = {}

        def bounds(j: int) -> dict[int, int]:
            """Places where tokens of a window start, with the token's number in it."""
            at, out = starts[j], {}
            for n, t in enumerate(ids_of[pieces[j]]):
                out[at] = n
                at += len(self.token[t])
            return out

        def shared(j: int, mine: dict[int, int], other: dict[int, int]) -> list[tuple[int, int, int]]:
            """Places where windows j and j + 1 may be joined, with the tokens on both sides; the middle of the overlap first."""
            middle = starts[j + 1] + STEP // 2
            both = sorted((p for p in mine.keys() & other.keys() if mine[p]), key=lambda p: abs(p - middle))
            return [(p, ids_of[pieces[j]][mine[p] - 1], ids_of[pieces[j + 1]][other[p]]) for p in both]

        at = [bounds(j) for j in range(len(starts))]
        joins = [shared(j, at[j], at[j + 1]) for j in range(len(starts) - 1)]
        self._meet({(a, b) for places in joins for _, a, b in places[:2]})
        out: list[int] = []
        p = j = 0
        far, reached = FAR, 0
        while p < len(raw):
            if p in at[j] and (not out or self._may_meet(out[-1], ids_of[pieces[j]][at[j][p]])):
                own, first = ids_of[pieces[j]], at[j][p]
                if j == len(starts) - 1:
                    return out + own[first:]
                place = next((b for b, left, right in joins[j] if b > p and self._may_meet(left, right)), None)
                if place is not None:
                    out += own[first : at[j][place]]
                    p, j = place, j + 1
                    continue
            # the windows don't meet here: go on from p alone, back where its first token doesn't fit
            far = FAR if p > reached else min(2 * far, 4095)
            reached = max(reached, p)
            window = raw[p : p + far]
            if window not in found:
                found[window] = self._encoded([window])[0]
            ids = found[window]
            if out and not self._may_meet(out[-1], ids[0]):
                p -= len(self.token[out.pop()])
            else:
                end = len(raw) if p + far >= len(raw) else p + far - self.longest
                for t in ids:
                    if p + len(self.token[t]) > end:
                        break
                    out.append(t)
                    p += len(self.token[t])
            j = min(p // STEP, len(starts) - 1)
        return out

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        short, long = ([i for i, x in enumerate(raw) if (len(x) > LONG) == big] for big in (False, True))
        for part in self._batches([raw[i] for i in short]):
            self._start(raw, [short[i] for i in part])
            self._keep(words, raw, ENCODE)
        for i in long:
            ids = self._long(raw[i])
            self._table("pieces", pa.table({"word": pa.array(np.full(len(ids), i)), "pos": pa.array(np.arange(len(ids))), "id": pa.array(ids, pa.int64())}))
            self._keep(words, raw, "SELECT * FROM pieces")

    def _keep(self, words: list[str], raw: list[bytes], encoded: str) -> None:
        for i, ids, text in self.db.execute(DECODE.format(encoded=encoded)).fetchall():
            self.known[words[i]] = ids
            if (decoded := bytes.fromhex(text)) != raw[i]:
                self.otherwise[words[i]] = decoded

    def encode(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """For every text, its ids joined by a space, and the bytes that they decode to."""
        cut = [self.words(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        new = [w for w in sorted(set().union(*cut)) if w not in self.known]
        if self.older:
            self.known.update((w, self.older[w]) for w in new if w in self.older)
            new = [w for w in new if w not in self.known]
        for i in range(0, len(new), CHUNK):
            self._learn(new[i : i + CHUNK])
        ids = [" ".join([self.known[w] for w in words]) for words in cut]
        if not self.otherwise:
            return [(x, "".join(words).encode()) for x, words in zip(ids, cut, strict=True)]
        return [(x, b"".join([self.otherwise.get(w) or w.encode() for w in words])) for x, words in zip(ids, cut, strict=True)]


_coders: dict[tuple[str, str], ByteBpe] = {}


def _coder(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteBpe(path, pattern)
    return _coders[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and decoded (binary, the bytes that the ids stand for) for every text."""

    def run(part: pa.RecordBatch) -> dict:
        coded = _coder(path, pattern).encode(part.column("text").to_pylist())
        return {
            "ids": pa.array([[int(x) for x in ids.split()] for ids, _ in coded], pa.list_(pa.int32())),
            "decoded": pa.array([decoded for _, decoded in coded], pa.binary()),
        }

    return map_text(id_and_text(df, id_col, text_col), run, "ids array<int>, decoded binary", TEXTS)


def encode_digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what `encode` gives, digested before it leaves the worker."""

    def run(part: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for ids, decoded in _coder(path, pattern).encode(part.column("text").to_pylist()):
            out["n_tokens"].append(ids.count(" ") + 1 if ids else 0)
            out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
        return {k: pa.array(v, pa.int64() if k == "n_tokens" else pa.string()) for k, v in out.items()}

    return map_text(id_and_text(df, id_col, text_col), run, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", TEXTS)


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
