"""Byte-level BPE by recursive queries.

Every partition opens an in-memory DuckDB database with the merge table. New words of the partition become rows of
(word, position, token). One round of a recursive query joins neighbouring tokens with the merge table and contracts the
leftmost pair of least rank in each word; the recursion ends when no word has a pair left. An ordered aggregation of the
token bytes turns ids back into text. Words are remembered by the worker, so a word that is common costs one look-up.
"""

from __future__ import annotations

import base64
import hashlib
import marshal
import re
import struct
import tempfile
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskloom.llm.rows import Known, map_texts

#: Words above this many bytes are contracted one statement a round, many pairs at once; bytes of them held at a time (one
#: longer word is held alone), and which share of the rows a round has to contract for the next one to be alike.
LONG_WORD, LONG_BYTES, SHARE = 256, 1 << 20, 0.01
#: Words contracted by one recursive query; units of text that a task remembers, and words that it does and hands on.
QUERY_WORDS = 10_000
KNOWN_UNITS, KNOWN_WORDS = 300_000, 500_000

_MERGE = """
WITH RECURSIVE step(depth, word, pos, nxt, tok, tok2, best) AS (
  SELECT 0, word, pos, nxt, tok, tok2, (m << 20) | pos
  FROM (SELECT *, lead(pos) OVER o AS nxt, lead(tok) OVER o AS tok2 FROM letters WINDOW o AS (PARTITION BY word ORDER BY pos)) s
  LEFT JOIN merges g ON g.l = s.tok AND g.r = s.tok2
  UNION ALL
  SELECT depth + 1, word, pos, nxt, tok, tok2, (m << 20) | pos
  FROM (
    SELECT s.depth, s.word, s.pos,
           CASE WHEN s.pos = h.pos THEN h.nxt ELSE s.nxt END AS nxt,
           CASE WHEN s.pos = h.pos THEN h.m ELSE s.tok END AS tok,
           CASE WHEN s.pos = h.pos THEN h.tok2 WHEN s.nxt = h.pos THEN h.m ELSE s.tok2 END AS tok2
    FROM step s
    JOIN (
      SELECT a.word, a.pos, a.m, b.pos AS gone, b.nxt, b.tok2
      FROM (SELECT word, (min(best) & 1048575)::INT AS pos, min(best) >> 20 AS m, arg_min(nxt, best) AS nxt
            FROM step GROUP BY word HAVING min(best) IS NOT NULL) a
      JOIN step b ON b.word = a.word AND b.pos = a.nxt
    ) h ON h.word = s.word
    WHERE s.pos <> h.gone
  ) s LEFT JOIN merges g ON g.l = s.tok AND g.r = s.tok2
), last AS (SELECT word, max(depth) AS depth FROM step GROUP BY word)
SELECT word, list(tok::INT ORDER BY pos) AS ids FROM step JOIN last USING (word, depth) GROUP BY word ORDER BY word
"""

#: One round over long words: ``hit`` says which pairs are contracted.
_ROUND = """
CREATE OR REPLACE TABLE later AS
WITH paired AS (
  SELECT s.*, g.m, g.plain FROM (SELECT *, row_number() OVER o AS i, lead(tok) OVER o AS tok2 FROM run WINDOW o AS (PARTITION BY word ORDER BY pos)) s
  LEFT JOIN merges g ON g.l = s.tok AND g.r = s.tok2
), {hits}
SELECT word, pos, (CASE WHEN hit THEN m ELSE tok END)::INT AS tok, bool_and(m IS NULL) OVER (PARTITION BY word) AS done
FROM (SELECT *, lag(hit, 1, false) OVER (PARTITION BY word ORDER BY pos) AS gone FROM final) WHERE NOT gone
"""

#: Pairs of least rank among all that begin within ``reach`` bytes, four times the longest token that occurs in the words.
#: What happens farther off cannot get to them before their turn, nor what they set off get there: no token is that long.
#: Equal ranks go from the left: the first of them, and where no token made from the pair has a lower rank (``plain``),
#: every other pair of a run.
_NEAR = _ROUND.format(hits="""
around AS (
  SELECT *, min(m) OVER (o RANGE BETWEEN $reach PRECEDING AND $reach FOLLOWING) AS low, min(m) OVER (o RANGE BETWEEN $reach PRECEDING AND 1 PRECEDING) AS low_before
  FROM paired WINDOW o AS (PARTITION BY word ORDER BY pos)
), islands AS (SELECT *, i - row_number() OVER (PARTITION BY word, m ORDER BY pos) AS island FROM around),
runs AS (SELECT *, row_number() OVER o % 2 = 1 AS odd, bool_and(m = low AND plain) OVER o AS free FROM islands WINDOW o AS (PARTITION BY word, m, island ORDER BY pos)),
final AS (SELECT *, coalesce(m = low AND (coalesce(low_before > m, true) OR (odd AND free)), false) AS hit FROM runs)
""")

#: Of the pairs of least rank in the word, read from the left and without overlap, all are contracted up to the first
#: whose contraction makes a neighbouring pair of lower rank: exactly those that come next one by one.
_LEAST = _ROUND.format(hits="""
least AS (SELECT *, min(m) OVER (PARTITION BY word) AS low FROM paired),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY word, m = low ORDER BY pos) AS island FROM least),
picked AS (SELECT *, coalesce(m = low, false) AND (row_number() OVER (PARTITION BY word, m = low, island ORDER BY pos)) % 2 = 1 AS pick FROM islands),
sides AS (
  SELECT *, CASE WHEN lag(pick, 2, false) OVER o THEN low ELSE lag(tok) OVER o END AS before, lead(tok, 2) OVER o AS after
  FROM picked WINDOW o AS (PARTITION BY word ORDER BY pos)
), stops AS (
  SELECT s.*, min(CASE WHEN pick AND (a.m < low OR b.m < low) THEN pos END) OVER (PARTITION BY word) AS stop
  FROM sides s LEFT JOIN merges a ON a.l = s.before AND a.r = s.low LEFT JOIN merges b ON b.l = s.low AND b.r = s.after
), final AS (SELECT *, pick AND (stop IS NULL OR pos <= stop) AS hit FROM stops)
""")

_DECODE = "SELECT seq, list(bytes ORDER BY pos) AS parts FROM coded JOIN vocabulary USING (id) GROUP BY seq ORDER BY seq"


_ID = struct.Struct("<I")


class Codec:
    """Encodes and decodes with the ranks of a vocabulary file; one database for each partition."""

    def __init__(self, ranks: dict[bytes, int], merges: pa.Table, pattern: str):
        import duckdb

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.letter = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": f"{tempfile.gettempdir()}/merges-{uuid.uuid4().hex}"})
        self._load("merges", merges)
        self.longest = max(map(len, ranks))
        self._load("vocabulary", pa.table({"id": pa.array(ranks.values(), pa.int32()), "bytes": pa.array(ranks.keys(), pa.binary())}))

    def close(self) -> None:
        self.con.close()

    def _load(self, name: str, incoming: pa.Table) -> None:
        # The query finds ``incoming`` by its name; every registered table would leave an object behind in the worker.
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")

    def _rows(self, words: list[bytes]) -> pa.Table:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer(b"".join(words), np.uint8)
        pos = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return pa.table({"word": np.repeat(np.arange(len(words), dtype=np.int32), lengths), "pos": pos.astype(np.int32), "tok": self.letter[letters]})

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word; a word of the vocabulary is its own token."""
        return [np.frombuffer(x, "<u4").tolist() for x in self.code(words)]

    def code(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        codes = [_ID.pack(self.ranks[w]) if w in self.ranks else b"" for w in words]
        short = [i for i, w in enumerate(words) if not codes[i] and 0 < len(w) <= LONG_WORD]
        for k in range(0, len(short), QUERY_WORDS):
            part = short[k : k + QUERY_WORDS]
            self._load("letters", self._rows([words[i] for i in part]))
            self._keep(_MERGE, part, codes)
        long = [i for i, w in enumerate(words) if not codes[i] and len(w) > LONG_WORD]
        reach = {i: 4 * self._longest_in(words[i]) for i in long}
        part, held = [], 0
        for i in sorted(long, key=reach.__getitem__):
            if part and held + len(words[i]) > LONG_BYTES:
                self._code_long(words, part, reach[part[-1]], codes)
                part, held = [], 0
            part.append(i)
            held += len(words[i])
        if part:
            self._code_long(words, part, reach[part[-1]], codes)
        return codes

    def _keep(self, query: str, part: list[int], codes: list[bytes]) -> None:
        """Puts the ids that a query gives for words, numbered as in ``part``, into ``codes``."""
        found = self.con.sql(query).to_arrow_table()
        lists = _whole(found.column("ids"))
        flat, edges = lists.flatten().to_numpy().astype("<u4").tobytes(), [0, *np.cumsum(pc.list_value_length(lists).to_numpy() * 4).tolist()]
        for word, start, end in zip(found.column("word").to_pylist(), edges, edges[1:], strict=False):
            codes[part[word]] = flat[start:end]

    def _longest_in(self, word: bytes) -> int:
        """Bytes of the longest token that occurs in the word."""
        return next((n for n in range(self.longest, 1, -1) if any(word[k : k + n] in self.ranks for k in range(len(word) - n + 1))), 1)

    def _code_long(self, words: list[bytes], part: list[int], reach: int, codes: list[bytes]) -> None:
        self._load("run", self._rows([words[i] for i in part]))
        left, near = sum(len(words[i]) for i in part), True
        while left:
            self.con.execute(_NEAR.replace("$reach", str(reach)) if near else _LEAST)
            self._keep("SELECT word, list(tok ORDER BY pos) AS ids FROM later WHERE done GROUP BY word", part, codes)
            kept = self.con.execute("SELECT count(*) FROM later").fetchone()[0]
            near = not near or left - kept > SHARE * left
            left = self.con.execute("CREATE OR REPLACE TABLE run AS SELECT word, pos, tok FROM later WHERE NOT done").fetchone()[0]

    def decode(self, sequences: list[list[int]]) -> list[bytes]:
        """The bytes of each sequence of ids. An id that the vocabulary lacks is an error."""
        return self.read([np.array(x, "<u4").tobytes() for x in sequences])

    def read(self, codes: list[bytes]) -> list[bytes]:
        """The bytes that ids, as little-endian unsigned 32-bit integers, stand for."""
        lengths = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        ids = np.frombuffer(b"".join(codes), "<u4").astype(np.int32)
        if len(ids) and not np.isin(np.unique(ids), np.fromiter(self.ranks.values(), np.int32, len(self.ranks))).all():
            raise ValueError("an id is not in the vocabulary")
        self._load("coded", pa.table({"seq": np.repeat(np.arange(len(codes), dtype=np.int32), lengths), "pos": np.arange(len(ids), dtype=np.int64), "id": ids}))
        found = self.con.sql(_DECODE).to_arrow_table()
        lists = _whole(found.column("parts"))
        parts = lists.flatten().cast(pa.large_binary())
        flat = b"".join(parts.to_pylist()) if parts.offset else parts.buffers()[2].to_pybytes() if len(parts) else b""
        ends = np.cumsum(np.concatenate([[0], pc.binary_length(parts).to_numpy()]))
        edges = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])].tolist()
        out = [b""] * len(codes)
        for seq, start, end in zip(found.column("seq").to_pylist(), edges, edges[1:], strict=False):
            out[seq] = flat[start:end]
        return out


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


class Words(dict):
    """What is known of words, at most about ``limit``: beyond it, those stay that were asked for again.

    A worker keeps them from task to task ``packed`` into one value: spread over the heap they would hold all of it.
    """

    def __init__(self, packed: bytes | None = None, limit: int | None = None):
        super().__init__(marshal.loads(packed) if packed else ())
        self.limit, self.again = KNOWN_WORDS if limit is None else limit, set()

    def packed(self) -> bytes:
        return marshal.dumps(dict(self))

    def missing(self, words: set[str]) -> list[str]:
        """The words that are not known; all others count as asked for again."""
        new = words.difference(self)
        self.again.update(words.difference(new))
        return list(new)

    def trim(self) -> None:
        if len(self) > self.limit:
            kept = {w: self[w] for w in self.again} if len(self.again) <= self.limit // 2 else {}
            self.clear()
            self.update(kept)
            self.again = set()


class Texts:
    """Encodes whole texts unit by unit.

    A unit runs from a single space between two visible characters up to the next one; no match of the pattern crosses
    its start, so units are encoded apart and remembered as (ids in bytes, decoded bytes). ``words`` are those that the
    worker knows already.
    """

    def __init__(self, codec: Codec, words: Words | None = None):
        self.codec = codec
        self.words = Words() if words is None else words
        self.units: dict[str, tuple[bytes, bytes]] = {}
        self.spaced: dict[str, tuple[bytes, bytes]] = {}  # by what follows the space

    @staticmethod
    def cut(pieces: list[str]) -> list[str]:
        units = [pieces[0]]
        for piece in pieces[1:]:
            if _visible(piece) and units[-1] and not units[-1][-1].isspace():
                units.append(" " + piece)
            else:
                units[-1] += " " + piece
        return units

    def learn(self, units: list[str], spaced: list[str]) -> None:
        findall = self.codec.pattern.findall
        singles = [p for p in spaced if p.isalpha()]
        matches = [(self.units, u, findall(u)) for u in units]
        matches += [(self.spaced, p, _split(p) or findall(" " + p)) for p in spaced if not p.isalpha()]
        new = {" " + p for p in singles}.union(chain.from_iterable(ws for _, _, ws in matches))
        words = self.words.missing(new)
        codes = self.codec.code([w.encode() for w in words])
        self.words.update(zip(words, zip(codes, self.codec.read(codes), strict=True), strict=True))
        found = self.words
        self.spaced.update((p, found[" " + p]) for p in singles)
        for known, u, ws in matches:
            codes = [found[w] for w in ws]
            known[u] = codes[0] if len(codes) == 1 else (b"".join([c[0] for c in codes]), b"".join([c[1] for c in codes]))

    def code(self, texts: list[bytes | None]) -> list[tuple[bytes, bytes]]:
        self.words.trim()
        if len(self.spaced) + len(self.units) > KNOWN_UNITS:
            self.units.clear()
            self.spaced.clear()
        decoded = [(t or b"").decode() for t in texts]
        cuts = [t.split(" ") for t in decoded]
        plain = [len(pieces) > 1 and _plain(t) for pieces, t in zip(cuts, decoded, strict=True)]
        whole = [[pieces[0]] if p else self.cut(pieces) for pieces, p in zip(cuts, plain, strict=True)]
        rest = set().union(*(pieces[1:] for pieces, p in zip(cuts, plain, strict=True) if p))
        self.learn(list(set(chain.from_iterable(whole)).difference(self.units)), list(rest.difference(self.spaced)))
        out = []
        for pieces, units, p in zip(cuts, whole, plain, strict=True):
            codes = [self.units[u] for u in units]
            if p:
                codes += map(self.spaced.__getitem__, pieces[1:])
            ids, back = zip(*codes, strict=True)
            out.append((b"".join(ids), b"".join(back)))
        return out


#: A space before white space, and one behind other white space.
_BEFORE, _BEHIND = re.compile(r" \s"), re.compile(r"[^\S ] ")


def _plain(text: str) -> bool:
    """Whether every space of the text starts a unit."""
    return text[0] != " " and text[-1] != " " and not _BEFORE.search(text) and not _BEHIND.search(text)


def _visible(piece: str) -> bool:
    return piece != "" and not piece[0].isspace() and not piece[-1].isspace()


def _split(piece: str) -> list[str] | None:
    """The matches of a space and ``piece`` where that is letters and marks; else None."""
    body = piece.rstrip(".,;:!?")
    return None if not body.isalpha() else [" " + body] if len(body) == len(piece) else [" " + body, piece[len(body) :]]


#: Of this worker, by vocabulary: tasks that it runs one after another share them.
_RANKS: dict[str, dict[bytes, int]] = {}
_MERGES: dict[str, pa.Table] = {}
_WORDS: dict[str, bytes] = {}


def read_ranks(vocabulary: str) -> dict[bytes, int]:
    if vocabulary not in _RANKS:
        import public_tokenizers

        with open(public_tokenizers.path(vocabulary), "rb") as lines:
            _RANKS[vocabulary] = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return _RANKS[vocabulary]


def _merges(ranks: dict[bytes, int]) -> pa.Table:
    """Tokens ``l`` and ``r`` that join to ``m``; ``plain``: no token made of ``m`` and one more has a lower rank."""
    splits = [(ranks[t[:i]], ranks[t[i:]], m) for t, m in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    left, right, merged = (np.array(x) for x in zip(*splits, strict=True)) if splits else (np.zeros(0, int),) * 3
    lowered = np.union1d(left[merged < left], right[merged < right])
    return pa.table({"l": left.astype(np.int32), "r": right.astype(np.int32), "m": merged.astype(np.int64), "plain": ~np.isin(merged, lowered)})


def _codec(vocabulary: str) -> Codec:
    import public_tokenizers

    ranks = read_ranks(vocabulary)
    if vocabulary not in _MERGES:
        _MERGES[vocabulary] = _merges(ranks)
    return Codec(ranks, _MERGES[vocabulary], public_tokenizers.PATTERN)


def encode_texts(docs: DataFrame, *, vocabulary: str = "byte_bpe_multi_50k.tiktoken", text: str = "text", carry: list[str] | None = None, keep_ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Adds ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned 32-bit integers), ``decoded_sha256`` and, if asked
    for, ``ids`` to the ``carry`` columns of every row. Null and empty texts have no ids. Special tokens are ordinary
    text. Repeated rows are encoded each; columns with the new names are replaced.
    """

    def make():
        coder = Texts(_codec(vocabulary), Words(_WORDS.get(vocabulary)))

        def work(texts: list[bytes | None]):
            codes = coder.code(texts)
            columns = [len(a) // 4 for a, _ in codes], [hashlib.sha256(a).hexdigest() for a, _ in codes], [hashlib.sha256(b).hexdigest() for _, b in codes]
            return (*columns, [np.frombuffer(a, "<u4").astype(np.int32) for a, _ in codes]) if keep_ids else columns

        def end():
            _WORDS[vocabulary] = coder.words.packed()

        work.end = end
        return work

    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    fields += [("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []
    return map_texts(docs, make, fields, carry=docs.columns if carry is None else carry, text=text)


def decode_ids(coded: DataFrame, *, vocabulary: str = "byte_bpe_multi_50k.tiktoken", ids: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """Adds ``decoded`` (binary) to the ``carry`` columns: the bytes of the ids. Null ids decode to no bytes."""
    carry = [c for c in (coded.columns if carry is None else carry) if c not in (ids, "decoded")]
    schema = T.StructType([*(coded.schema[c] for c in carry), T.StructField("decoded", T.BinaryType())])

    def run(batches):
        codec = _codec(vocabulary)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = codec.decode([x or [] for x in part.column(ids).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(found, pa.binary())], [*carry, "decoded"])

    return coded.select(*carry, ids).mapInArrow(run, schema)
