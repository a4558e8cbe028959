"""Token counts by a compiled finite-state transducer (operator 6).

A BPE encoder is turned into a deterministic transducer over characters.  Two facts make
that possible: the encoding of a prefix is decided by its last token, and two tokens may
stand side by side exactly when the encoder leaves their concatenation as those two
tokens.  A state therefore holds, for every start position that can still begin a
vocabulary piece, the last token before it and the tokens emitted since; a transition
carries the (possibly negative) change of the emitted-token count.  States are
determinised on demand and kept in a bounded table.

A long text is cut into chunks of characters.  A unit boundary (a mark that follows another
character) resets the transducer, so the map of a chunk from any entry state to its exit
state and count is told by the characters before its first boundary, the tokens between its
first and last one, and the state and tokens behind the last: only what comes first depends
on the entry state, and is run from it when maps are composed.  The maps form a monoid and
are composed by a prefix scan of logarithmic depth.  Whole units between boundaries always
start in the first state, so their counts are remembered.

Defined results: a null or empty text has 0 tokens; ties and repeated rows are counted
each on their own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.llm.bytetext import tidy
from spanforge.llm.columns import beside, unused

SPACE = "▁"
MAX_STATES = 400_000
MAX_UNITS = 1_500_000
CHUNK_CHARS = 1 << 16


#: The first state: nothing read, nothing emitted.
START = ("", (("", 0),))


class ChunkMap(NamedTuple):
    """From any entry state to the exit state and the tokens between, over one chunk.

    head: the characters that depend on the entry state; inner: tokens up to the last boundary, null
    if the chunk has none (it is all head then); exit, count: state and tokens behind the last
    boundary; marked: does the chunk end with a mark?
    """

    head: str
    inner: int | None
    exit: tuple
    count: int
    marked: bool


class CountTransducer:
    """Lazily determinised token counter of a sentence-piece BPE model with byte fallback.

    The model must use the identity normaliser, a dummy prefix and no inner word marks,
    which is checked when it is loaded.
    """

    def __init__(self, pieces: dict[str, float], max_states: int = MAX_STATES, max_units: int = MAX_UNITS):
        self.score = pieces
        self.max_states, self.max_units = max_states, max_units
        self.starts = {p[:k] for p in pieces for k in range(1, len(p))}
        self.spanned = {c for p in pieces if len(p) > 1 for c in p}
        self._split: dict[str, tuple[str, ...]] = {}
        self._pair: dict[tuple[str, str], bool] = {}
        self.units: dict[str, int] = {}
        self._reset()

    @classmethod
    def load(cls, model_file: str) -> CountTransducer:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm, spec = model.normalizer_spec, model.trainer_spec
        pieces = {p.piece: p.score for p in model.pieces if p.type == 1}
        plain = norm.name == "identity" and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        if spec.model_type != 2 or not spec.byte_fallback or not plain or any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("only BPE models with byte fallback, identity normaliser and word-initial marks can be compiled")
        return cls(pieces)

    def _reset(self) -> None:
        self.live: list[tuple[str, tuple[tuple[str, int], ...]]] = [START]
        self.ids = {self.live[0]: 0}
        self.arcs: list[dict[str, tuple[int, int]]] = [{}]

    def split(self, text: str) -> tuple[str, ...]:
        """Pieces of a short string by the merge rule: best score first, then leftmost."""
        got = self._split.get(text)
        if got is None:
            parts = list(text)
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    s = self.score.get(parts[i] + parts[i + 1])
                    if s is not None and (best is None or s > best):
                        best, at = s, i
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(self._split) > self.max_states:
                self._split.clear()
            got = self._split[text] = tuple(parts)
        return got

    def fits(self, left: str, right: str) -> bool:
        """May these two pieces stand side by side?"""
        key = (left, right)
        got = self._pair.get(key)
        if got is None:
            if len(self._pair) > 4 * self.max_states:
                self._pair.clear()
            got = self._pair[key] = self.split(left + right) == key
        return got

    def step(self, state: int, char: str) -> tuple[int, int]:
        """Target state and change of the count; compiled at the first visit."""
        arc = self.arcs[state].get(char)
        if arc is not None:
            return arc
        text, live = self.live[state]
        text += char
        # The k-th entry belongs to the suffix that starts k characters into the text.
        for k, (last, count) in enumerate(live):
            if last is None:
                continue
            piece = text[k:]
            if (len(piece) == 1 or (piece in self.score and self.split(piece) == (piece,))) and (not last or self.fits(last, piece)):
                change = count + 1
                newest = piece
                break
        else:
            raise AssertionError("a prefix without an encoding")
        entries = [(last, count - change) if last is not None and text[k:] in self.starts else (None, 0) for k, (last, count) in enumerate(live)]
        entries.append((newest, 0))
        first = next(k for k, e in enumerate(entries) if e[0] is not None)
        to = self._number((text[first:], tuple(entries[first:])))
        self.arcs[state][char] = arc = (to, change)
        return arc

    def advance(self, live: tuple, text: str) -> tuple[tuple, int]:
        """The state reached from a state (given by what it holds) over some text, and the change of the count."""
        if len(self.live) > self.max_states:
            self._reset()
        state, total, spanned = self._number(live), 0, self.spanned
        for c in text:
            if c not in spanned:
                total += 1 if c in self.score else len(c.encode("utf-8", "surrogatepass"))
                state = 0
            else:
                state, change = self.arcs[state].get(c) or self.step(state, c)
                total += change
        return self.live[state], total

    def _number(self, live: tuple) -> int:
        at = self.ids.get(live)
        if at is None:
            at = self.ids[live] = len(self.live)
            self.live.append(live)
            self.arcs.append({})
        return at

    def run(self, unit: str) -> int:
        """Tokens of one unit: the sum of the changes along its path, and byte fallback."""
        total, state = 0, 0
        for part in self._islands(unit):
            if len(part) == 1 and part not in self.spanned:
                total += 1 if part in self.score else len(part.encode("utf-8", "surrogatepass"))
                continue
            state = 0
            if len(self.live) > self.max_states:
                self._reset()
            arcs, step = self.arcs, self.step
            for c in part:
                arc = arcs[state].get(c)
                state, change = arc if arc is not None else step(state, c)
                total += change
        return total

    def _islands(self, unit: str) -> Iterator[str]:
        """Cuts at characters that stand alone in every piece."""
        spanned, begin = self.spanned, 0
        if spanned.issuperset(unit):
            yield unit
            return
        for i, c in enumerate(unit):
            if c not in spanned:
                if begin < i:
                    yield unit[begin:i]
                yield c
                begin = i + 1
        if begin < len(unit):
            yield unit[begin:]

    def tokens(self, unit: str) -> int:
        got = self.units.get(unit)
        if got is None:
            if len(self.units) > self.max_units:
                self.units.clear()
            got = self.run(unit)
            if len(unit) <= 64:
                self.units[unit] = got
        return got

    def cut(self, chunk: str) -> tuple[str, int | None, str]:
        """Characters before the first boundary, tokens up to the last one (null if there is none), characters behind it."""
        words = chunk.split(" ")
        # A space right after a space continues a run of marks and is no boundary.
        units: list[str] = []
        run = ""
        for w in words[1:]:
            if w:
                units.append(run + SPACE + w)
                run = ""
            else:
                run += SPACE
        if run:
            units.append(run)
        lead = words[0]
        if not units:
            return lead, None, ""
        if not lead:  # opens with a space: whether a boundary stands there is up to the chunk before
            lead, units = units[0], units[1:]
            if not units:
                return lead, None, ""
        get = self.units.get
        inner = 0
        for u in units[:-1]:
            n = get(u)
            inner += self.tokens(u) if n is None else n
        return lead, inner, units[-1]

    def chunk_map(self, chunk: str) -> ChunkMap:
        head, inner, tail = self.cut(chunk)
        if inner is None:
            return ChunkMap(head, None, START, 0, head[-1:] == SPACE)
        return ChunkMap(head, inner, *self.advance(START, tail), tail[-1:] == SPACE)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of a followed by b; a boundary stands between them where b begins with a mark behind another character."""
        fresh = b.head[:1] == SPACE and not a.marked
        if a.inner is None:
            if not fresh:
                return b._replace(head=a.head + b.head)
            if b.inner is None:
                return ChunkMap(a.head, 0, *self.advance(START, b.head), b.marked)
            return b._replace(head=a.head, inner=self.tokens(b.head) + b.inner)
        done = a.inner + (a.count if fresh else 0)
        live, count = self.advance(START if fresh else a.exit, b.head)
        count += 0 if fresh else a.count
        if b.inner is None:
            return ChunkMap(a.head, done, live, count, b.marked)
        return ChunkMap(a.head, done + count + b.inner, b.exit, b.count, b.marked)

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """All prefix compositions in ceil(log2 n) rounds (every round's steps are independent)."""
        done, step = list(maps), 1
        while step < len(done):
            done = [self.compose(done[i - step], done[i]) if i >= step else done[i] for i in range(len(done))]
            step *= 2
        return done

    def count(self, text: str | None, chunk_chars: int = CHUNK_CHARS) -> int:
        if not text:
            return 0
        text = " " + text.replace(SPACE, " ")
        if len(text) <= chunk_chars:
            head, inner, tail = self.cut(text)
            return self.tokens(head) + (inner or 0) + (self.tokens(tail) if tail else 0)
        whole = self.scan([self.chunk_map(text[i : i + chunk_chars]) for i in range(0, len(text), chunk_chars)])[-1]
        return self.tokens(whole.head) + (whole.inner or 0) + whole.count


_LOADED: dict[str, CountTransducer] = {}


def count_tokens(df: DataFrame, model_file: str, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 4096) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit to the kept columns; a narrow map without shuffle."""
    named = beside(keep, ("n_bytes", "n_tokens", "over_limit"))
    src = df.select(*[F.col(f"`{c}`").alias(x) for c, x in named.items()], F.col(text_col).cast("string").alias(unused("text", named.values())))
    keep = tuple(named.values())
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType()), T.StructField("n_bytes", T.LongType())])
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _LOADED.get(model_file)
        if fst is None:
            fst = _LOADED[model_file] = CountTransducer.load(model_file)
        for b in batches:
            texts = b.column(b.num_columns - 1)
            counts = [fst.count(t) for t in texts.to_pylist()]
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(counts, pa.int64()), sizes], names=[*names, "n_tokens", "n_bytes"])

    out = src.mapInArrow(tidy(run), schema)
    return out.select(*keep, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
