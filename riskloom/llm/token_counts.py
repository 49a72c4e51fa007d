"""Token counts by a transducer compiled from a merge vocabulary.

Merging always yields one segmentation, and a sequence of pieces is that segmentation exactly when each neighbouring
pair of pieces is. So the last piece of a prefix follows from the last pieces of shorter prefixes, and reading a text
character by character is a deterministic machine: a state holds every start from which a piece may still grow, the
piece that ended there, and how many tokens fewer were then emitted. A transition carries the change of the number of
emitted tokens, which is negative where the new character lets pieces merge. States and transitions are compiled when
first met and shared by all texts of a worker.

A space that follows another character ends everything before it, since no piece has one inside. The machine is then
in its start state again, whatever came before; a chunk of text therefore maps every entry state to (exit state, count)
by its part before the first such place and one fixed remainder. These maps compose associatively, so the chunks of a
long text are scanned in a tree.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskloom.llm.rows import Known, map_texts

#: Characters of a chunk.
CHUNK = 1 << 15
#: Transitions that a worker keeps.
KNOWN_EDGES = 300_000
#: Longer segments are run through the machine each time.
REMEMBERED = 48

SPACE = "▁"
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*")
_RESET = re.compile(f"(?<=[^{SPACE}]){SPACE}")
START = (("", None, 0),)


class Transducer:
    """``scores``: every piece that merging may produce, the best first to be merged."""

    def __init__(self, scores: dict[str, float]):
        if bad := next((p for p in scores if _RESET.search(p)), None):
            raise ValueError(f"the piece {bad!r} has a space inside")
        self.scores = scores
        self.open = {p[:i] for p in scores for i in range(1, len(p))}
        self.merged = Known(self._merge)
        self.segments = Known(lambda s: self.run(START, s)[1])
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.n_edges = 0

    def _number(self, state: tuple) -> int:
        n = self.numbers.setdefault(state, len(self.states))
        if n == len(self.states):
            self.states.append(state)
            self.edges.append({})
        return n

    def _merge(self, text: str) -> tuple[str, ...]:
        """The segmentation by definition: merge the leftmost best pair until none is left."""
        parts, none, get = list(text), float("-inf"), self.scores.get
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := max(pairs)) > none:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
        return tuple(parts)

    def cost(self, piece: str) -> int:
        """A character without a piece is spelled in bytes."""
        return 1 if piece in self.scores else len(piece.encode())

    def _compile(self, state: tuple, char: str) -> tuple[tuple, int]:
        grown = [(text + char, last, count) for text, last, count in state]
        for text, last, count in grown:
            if len(text) > 1 and text not in self.scores:
                continue
            if self.merged[text] == (text,) if last is None else self.merged[last + text] == (last, text):
                ended, change = text, count + self.cost(text)
                break
        return (*((t, p, n - change) for t, p, n in grown if t in self.open), ("", ended, 0)), change

    def run(self, state: tuple, text: str) -> tuple[tuple, int]:
        """The state after ``text`` and the change of the number of tokens."""
        if self.n_edges > KNOWN_EDGES:
            self._forget()
        at, total, edges = self._number(state), 0, self.edges
        for char in text:
            edge = edges[at].get(char)
            if edge is None:
                after, change = self._compile(self.states[at], char)
                edge = edges[at][char] = self._number(after), change
                self.n_edges += 1
            at = edge[0]
            total += edge[1]
        return self.states[at], total

    def count(self, segments: list[str]) -> int:
        return sum(map(self.segments.__getitem__, segments)) if max(map(len, segments), default=0) <= REMEMBERED else sum(self.segments[s] if len(s) <= REMEMBERED else self.run(START, s)[1] for s in segments)


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does to any entry state: run ``head``; unless ``exit`` is None, start anew, emit ``count`` and leave in ``exit``."""

    head: str
    count: int = 0
    exit: tuple | None = None

    @classmethod
    def of(cls, machine: Transducer, chunk: str) -> ChunkMap:
        resets = _RESET.search(chunk)
        if not resets:
            return cls(chunk)
        body = chunk[resets.start() :]
        *whole, tail = _SEGMENT.findall(body)
        state, count = machine.run(START, tail)
        return cls(chunk[: resets.start()], machine.count(whole) + count, state)

    def then(self, machine: Transducer, other: ChunkMap) -> ChunkMap:
        if self.exit is None:
            return ChunkMap(self.head + other.head, other.count, other.exit)
        state, count = machine.run(self.exit, other.head)
        return ChunkMap(self.head, self.count + count + other.count, state if other.exit is None else other.exit)


def composed(machine: Transducer, maps: list[ChunkMap]) -> ChunkMap:
    """The product of the maps, in a balanced tree."""
    while len(maps) > 1:
        maps = [maps[i].then(machine, maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def chunks_of(text: str, size: int) -> list[str]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def count_text(machine: Transducer, text: str, chunk: int = CHUNK) -> int:
    if not text:
        return 0
    text = SPACE + text.replace(" ", SPACE)
    if len(text) <= chunk:
        return machine.count(_SEGMENT.findall(text))
    whole = composed(machine, [ChunkMap.of(machine, c) for c in chunks_of(text, chunk)])
    return machine.run(START, whole.head)[1] + whole.count


_MACHINES: dict[str, Transducer] = {}


def machine_for(vocabulary: str) -> Transducer:
    """The transducer of a piece model, one per worker process."""
    if vocabulary not in _MACHINES:
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
        plain = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
        _MACHINES[vocabulary] = Transducer({model.id_to_piece(i): model.get_score(i) for i in plain})
    return _MACHINES[vocabulary]


def count_tokens(docs: DataFrame, *, vocabulary: str = "piece_bpe_32k.model", text: str = "text", carry: list[str] | None = None, limit: int = 4096, chunk: int = CHUNK) -> DataFrame:
    """Adds ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) to the ``carry`` columns of every row.

    Counts are those of the vocabulary's own library without begin, end or special tokens: a space stands before the
    text, characters without a piece count by their UTF-8 bytes. Null and empty texts have no bytes and no tokens. A text
    of any length is read whole, in chunks. Repeated rows are counted each; columns with the new names are replaced.
    """

    def make():
        machine = machine_for(vocabulary)

        def work(texts: list[bytes | None]):
            counts = [count_text(machine, (t or b"").decode(), chunk) for t in texts]
            return [len(t or b"") for t in texts], counts, [n > limit for n in counts]

        return work

    fields = [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())]
    return map_texts(docs, make, fields, carry=docs.columns if carry is None else carry, text=text)
