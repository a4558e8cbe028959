"""Language-model scores by a hierarchical Pitman-Yor model (operator 2).

Two levels of Chinese restaurants: one for each previous word (a text opens in the restaurant
of the end), all of these with one parent, whose base is uniform over the V training tokens
and one unknown.  Every table sends one customer to the parent.  Table counts are sampled by
Gibbs: given all others, the tables of a dish follow the generalised Stirling numbers up to
``EXACT`` customers; further customers of a dish are seated in doubling blocks under the
probability at the block's start.  Predictive probabilities are averaged over ``SAMPLES``
sweeps after ``BURN_IN``; a text's score is the sum of the logarithms of these averages, and
-score / n_tokens is the log10 perplexity.

Nothing is collected but a few totals and the words of ``HOT_PAIRS`` pairs and more, of which
there is at most one for so many pairs of the corpus.  Documents are cut into slices of about
``SLICE_TOKENS`` tokens, kept as ranks of words.  A slice sends its distinct (word, previous
word) pairs with their training counts to buckets of words, once each however often they
occur; a hot word's pairs are dealt further by the previous word, so no bucket grows with one
word.  Before sampling, the buckets exchange the number of distinct followers of every
previous word, the pairs of hot words and the totals of the whole corpus, so that each seats
its customers beside all those of the others as they are with one table a pair.  After it
they exchange tables again, and final probabilities use exact totals and sum to one.  Buckets
answer with small integers: customers and summed tables of a pair, and the parent's counts of
a word once a slice.

Previous words are known by 48 bits of their hash, words by 64.  Defined results: a null or
empty text is its end alone; a null id is in the training part (its text is empty); repeated
rows count and are scored each on their own; without training rows the base is one in V + 1 =
1; an empty table gives an empty result; columns beside id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.bytetext import Bytes, slices, tidy
from spanforge.llm.storage import written

SLICE_TOKENS = 2_000_000
BUCKET_BYTES = 24 << 20
HOT_PAIRS = 2_000_000
HOT_LEAST = 4096
DISCOUNT, STRENGTH = 0.75, 1.0
BASE_DISCOUNT, BASE_STRENGTH = 0.75, 10.0
EXACT = 64
BURN_IN, SAMPLES = 2, 2
END = np.uint64(0x9D39247E33776D41)
HELD_OUT = (7, 2)
_SHORT = np.uint64(16)


def held_out(doc_id: int | None) -> bool:
    """Is this text kept out of training?"""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT[0] == HELD_OUT[1]


def _zip(*arrays: np.ndarray) -> bytes:
    """Arrays in one frame, each as planes of equal bytes, which compress well for small numbers."""
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes()
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"" for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def _unzip(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(raw, np.int64, n, 8), 8 * (n + 1), []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        wide = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(wide, size // wide)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size
    return out


def tokens(b: Bytes) -> tuple[np.ndarray, np.ndarray]:
    """(word, tokens per text): 64-bit hashes, each text closed by END."""
    w = b.words()
    per = w.per_doc(b.n)
    return np.insert(w.code, np.cumsum(per), END), per + 1


def home(key: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a 48-bit key; grows with the key."""
    return ((key >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(32)


def runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    edges = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, int)
    return list(zip(edges.tolist(), np.append(edges[1:], len(x)).tolist(), strict=True))


def cut(docs: DataFrame) -> DataFrame:
    """Rows (slice, words, texts, train_tokens, hot): a slice's words in order of their hash, its
    texts as words, its training tokens, and its words with many pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, seq = TaskContext.get().partitionId() << 32, 0
        keys, counts, ids, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, keys, counts, ids, total
            key, per, keys = np.concatenate(keys), np.concatenate(counts), []
            vocab, word = np.unique(key, return_inverse=True)
            n = np.bincount(word, minlength=len(vocab))
            # Frequent words get small numbers; place tells each its position by hash.
            place = np.argsort(-n, kind="stable").astype(np.uint32)
            rank = np.empty(len(vocab), np.uint32)
            rank[place] = np.arange(len(vocab), dtype=np.uint32)
            test = np.array([held_out(i) for i in ids])
            text = _zip(rank[word], place, per.astype(np.uint32), np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids]), test)
            often = n[word] >= HOT_LEAST  # no other word can have as many pairs
            pair = np.unique(word[often] * len(vocab) + _before(vocab, word)[often])
            wide = np.bincount(pair // len(vocab), minlength=len(vocab))
            hot = np.flatnonzero(wide >= HOT_LEAST)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([base + seq]), pa.array([_zip(vocab)], pa.binary()), pa.array([text], pa.binary()), pa.array([int(per[~test].sum())]),
                    pa.array([[{"word": int(w), "pairs": int(p)} for w, p in zip(vocab[hot].view(np.int64), wide[hot], strict=True)]], pa.list_(pa.struct([("word", pa.int64()), ("pairs", pa.int64())]))),
                ],
                names=["slice", "words", "texts", "train_tokens", "hot"],
            )
            seq, keys, counts, ids, total = seq + 1, [], [], [], 0
            return out

        for part in slices(batches, 1):
            key, per = tokens(Bytes(part.column(1), lower=True))
            keys.append(key)
            counts.append(per)
            ids += part.column(0).to_pylist()
            total += len(key)
            if total >= SLICE_TOKENS:
                yield flush()
        if ids:
            yield flush()

    return docs.mapInArrow(tidy(run), "slice long, words binary, texts binary, train_tokens long, hot array<struct<word:long,pairs:long>>")


def _before(vocab: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The previous word of each token; an end stands before the first."""
    return np.append(np.searchsorted(vocab, END), word[:-1])


def _texts(blob: bytes) -> tuple[np.ndarray, ...]:
    """(word of each token, tokens per text, ids, null ids, held out) of a slice."""
    rank, place, per, ids, null, test = _unzip(blob, np.uint32, np.uint32, np.uint32, np.int64, np.bool_, np.bool_)
    return place[rank].astype(np.int64), per.astype(np.int64), ids, null, test


class Deal:
    """Which bucket a pair goes to: its word's, or for hot words one of several by the previous word."""

    def __init__(self, buckets: int, hot: dict[int, int]):
        self.buckets = buckets
        self.hot = np.array(sorted(hot), np.uint64)  # words as unsigned hashes
        self.shares = np.array([hot[w] for w in sorted(hot)], np.int64)
        self.first = buckets + np.cumsum(self.shares) - self.shares

    def __call__(self, words: np.ndarray, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        out = home(words >> _SHORT, self.buckets).astype(np.int64)[word]
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, words), len(self.hot) - 1)
            own = np.where(self.hot[at] == words, at, -1)[word]
            which = np.flatnonzero(own >= 0)
            h = own[which]
            out[which] = self.first[h] + home(context[which], 1 << 24).astype(np.int64) * self.shares[h] // (1 << 24)
        return out

    def share(self, bucket: int) -> float:
        """The part of its word's pairs that a bucket has."""
        if bucket < self.buckets:
            return 1.0
        return 1.0 / self.shares[np.searchsorted(self.first, bucket, "right") - 1]


def pairs(parts: DataFrame, deal: Deal) -> DataFrame:
    """Rows (slice, bucket, run, blob): the pairs of a slice by word and previous word, in runs of one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, w, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                vocab = _unzip(w, np.uint64)[0]
                word, per, _, _, test = _texts(t)
                key = word * len(vocab) + _before(vocab, word)
                uniq, inverse = np.unique(key, return_inverse=True)
                seen = np.bincount(inverse[np.repeat(~test, per)], minlength=len(uniq)).astype(np.uint32)
                word, context = uniq // len(vocab), vocab[uniq % len(vocab)] >> _SHORT
                bucket = deal(vocab, word, context)
                rows = []
                for k, (a, z) in enumerate(runs(bucket)):
                    mine = word[a:z]
                    begin = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
                    # Previous words ascend behind each word: differences are smaller numbers.
                    gap = np.diff(context[a:z], prepend=np.uint64(0))
                    gap[begin] = context[a:z][begin]
                    six = np.ascontiguousarray(gap).view(np.uint8).reshape(-1, 8)[:, :6].T.ravel()
                    rows.append((number, int(bucket[a]), k, _zip(vocab[mine[begin]], np.diff(np.append(begin, z - a)).astype(np.uint32), six, seen[a:z])))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["slice", "bucket", "run", "blob"])

    return parts.select("slice", "words", "texts").mapInArrow(tidy(run), "slice long, bucket long, run long, blob binary")


def _open(blob: bytes) -> tuple[np.ndarray, ...]:
    """(words, pairs of each, previous word of each pair, training count of each) of a run."""
    words, many, six, seen = _unzip(blob, np.uint64, np.uint32, np.uint8, np.uint32)
    gap = np.zeros((len(seen), 8), np.uint8)
    gap[:, :6] = six.reshape(6, len(seen)).T
    gap = gap.view(np.uint64).ravel()
    total = np.cumsum(gap)
    begin = np.cumsum(many, dtype=np.int64) - many
    context = total - np.repeat(total[begin] - gap[begin], many)
    return words, many, context, seen


class Merged:
    """The pairs of a bucket over all slices, in order of slice and run."""

    def __init__(self, t: pa.Table):
        t = t.sort_by([("slice", "ascending"), ("run", "ascending")])
        self.slice, self.run = t.column("slice"), t.column("run")
        got = [_open(x.as_py()) for x in t.column("blob")]
        self.words, self.of_word = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        self.contexts, of_context = np.unique(np.concatenate([g[2] for g in got]), return_inverse=True)
        self.many = np.concatenate([g[1] for g in got])
        pair = np.repeat(self.of_word, self.many) * len(self.contexts) + of_context
        del of_context
        self.pair, of_pair = np.unique(pair, return_inverse=True)
        del pair
        self.of_pair = of_pair.astype(np.int32)  # a bucket holds far less than 2**31 pairs
        self.count = np.bincount(self.of_pair, np.concatenate([g[3] for g in got]), minlength=len(self.pair)).astype(np.int64)
        self.words_in = [len(g[0]) for g in got]
        self.pairs_in = [len(g[2]) for g in got]
        self.word, self.context = (self.pair // len(self.contexts)).astype(np.int32), (self.pair % len(self.contexts)).astype(np.int32)


def followers(parts: DataFrame, deal: Deal) -> DataFrame:
    """Rows (bucket, home, blob, totals): for the previous words of a bucket, and for its own word if that
    is hot, the distinct pairs seen in all buckets, by home; and words, pairs and buckets of the corpus."""
    n = deal.buckets

    def send(t: pa.Table) -> pa.Table:
        bucket, m = t.column("bucket")[0].as_py(), Merged(t)
        seen = m.count > 0
        many = np.bincount(m.context[seen], minlength=len(m.contexts)).astype(np.uint32)
        types = len(np.unique(m.word[seen])) * deal.share(bucket)
        totals = [float(types), float(seen.sum())]
        at = home(m.contexts, n).astype(np.int64)
        lo, hi = np.searchsorted(at, np.arange(n)), np.searchsorted(at, np.arange(n), "right")
        hot = int(home(m.words[:1] >> _SHORT, n)[0]) if bucket >= n else -1
        some = lambda h: m.words[: int(h == hot)] >> _SHORT
        blobs = [_zip(m.contexts[a:z], many[a:z], some(h), np.full(int(h == hot), int(seen.sum()), np.uint32)) for h, (a, z) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True))]
        return pa.table({"bucket": pa.array([bucket] * n, pa.int64()), "home": pa.array(range(n), pa.int64()), "blob": pa.array(blobs, pa.binary()), "totals": pa.array([totals] * n, pa.list_(pa.float64()))})

    def add(t: pa.Table) -> pa.Table:
        got = [_unzip(x.as_py(), np.uint64, np.uint32, np.uint64, np.uint32) for x in t.column("blob")]
        sums = []
        for k in (0, 2):  # previous words, hot words
            _, of = np.unique(np.concatenate([g[k] for g in got]), return_inverse=True)
            cuts = np.append(0, np.cumsum([len(g[k]) for g in got]))
            total = np.bincount(of, np.concatenate([g[k + 1] for g in got]))[of].astype(np.uint32) if len(of) else np.zeros(0, np.uint32)
            sums.append([total[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)])
        whole = np.sum(np.array(t.column("totals").to_pylist()), 0).tolist()
        return pa.table({"bucket": t.column("bucket"), "home": t.column("home"), "blob": pa.array([_zip(a, b) for a, b in zip(*sums, strict=True)], pa.binary()), "totals": pa.array([whole] * len(got), pa.list_(pa.float64()))})

    schema = "bucket long, home long, blob binary, totals array<double>"
    return parts.groupBy("bucket").applyInArrow(send, schema).groupBy("home").applyInArrow(add, schema)


def _stirling() -> np.ndarray:
    """log of the generalised Stirling numbers S(n, t) at DISCOUNT; row n, column t."""
    s = np.full((EXACT + 1, EXACT + 1), -np.inf)
    s[0, 0] = 0
    for n in range(EXACT):
        t = np.arange(1, n + 2)
        with np.errstate(divide="ignore"):
            s[n + 1, t] = np.logaddexp(s[n, t - 1], np.log(np.maximum(n - DISCOUNT * t, 0)) + s[n, t])
    return s


def seat(count: np.ndarray, tables: np.ndarray, others: np.ndarray, strength: float, discount: float, prior: np.ndarray, stirling: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A new number of tables for every dish, given the tables of all other dishes."""
    new = np.minimum(count, 1)
    top = np.minimum(count, EXACT)
    order = np.argsort(top, kind="stable")
    edge = np.searchsorted(top[order], np.arange(EXACT + 2))
    for n in range(2, EXACT + 1):
        rows = order[edge[n] : edge[n + 1]]
        if not len(rows):
            continue
        t = np.arange(1, n + 1)
        # P(t) ~ S(n, t) * prior**t * prod_{j < t} (strength + discount * (others + j))
        rise = np.log(strength + discount * (others[rows, None] + np.arange(n)[None, :])).cumsum(1)
        w = stirling[n, t] + t * np.log(prior[rows])[:, None] + rise
        w = np.exp(w - w.max(1, keepdims=True)).cumsum(1)
        new[rows] = 1 + (w < rng.random(len(rows))[:, None] * w[:, -1:]).sum(1)
    rows, done = np.flatnonzero(count > EXACT), EXACT
    while len(rows):
        step = np.minimum(count[rows] - done, done)
        open_ = (strength + discount * (others[rows] + new[rows])) * prior[rows]
        new[rows] += rng.binomial(step, open_ / (open_ + done - discount * new[rows]))
        done *= 2
        rows = rows[count[rows] > done]
    return new


def seatings(word: np.ndarray, context: np.ndarray, count: np.ndarray, n_words: int, start: np.ndarray, guests_start: np.ndarray, types: float, all_guests: float, seed: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Per kept sweep: tables of each pair, and the parent's tables of each word.

    start: the contexts' tables, guests_start: the words' customers in the parent, types and all_guests:
    words and parent's customers, all over every bucket and with one table a pair.
    """
    rng, stirling = np.random.default_rng(seed), _stirling()
    first = np.minimum(count, 1)
    own = np.bincount(word, first, minlength=n_words)
    elsewhere = guests_start - own  # of a hot word
    away = np.maximum(start - np.bincount(context, first, minlength=len(start)), 0)
    known = max(int((own > 0).sum()), 1)
    tables, uniform = first, 1 / (types + 1)
    upper = np.minimum(own + elsewhere, 1).astype(np.int64)
    for sweep in range(BURN_IN + SAMPLES):
        guests = (np.bincount(word, tables, minlength=n_words) + elsewhere).astype(np.int64)
        total = max(all_guests - own.sum(), 0) + np.bincount(word, tables, minlength=n_words).sum()
        # The parent's tables elsewhere: as many a word as here, or one a word beside a hot one.
        all_upper = upper.sum() + (types - known) * (1.0 if elsewhere.any() else upper.sum() / known)
        upper = seat(guests, upper, np.maximum(all_upper - upper, 0).astype(float), BASE_STRENGTH, BASE_DISCOUNT, np.full(n_words, uniform), stirling, rng)
        p = (guests - BASE_DISCOUNT * upper + (BASE_STRENGTH + BASE_DISCOUNT * all_upper) * uniform) / (BASE_STRENGTH + total)
        room = (away + np.bincount(context, tables, minlength=len(start)))[context]
        tables = seat(count, tables, np.maximum(room - tables, 0).astype(float), STRENGTH, DISCOUNT, np.clip(p[word], 1e-300, 1.0), stirling, rng)
        if sweep >= BURN_IN:
            yield tables, np.minimum(upper, np.bincount(word, tables, minlength=n_words).astype(np.int64) + elsewhere.astype(np.int64))


def answers(parts: DataFrame, starts: DataFrame, deal: Deal) -> DataFrame:
    """Rows (slice, place, blob, totals): what each slice needs of each run; as slice -1 the bucket's
    totals; as slice -2 its contexts' tables, for the homes named by place."""
    n = deal.buckets

    def run(t: pa.Table, s: pa.Table) -> pa.Table:
        bucket, m = t.column("bucket")[0].as_py(), Merged(t)
        s = s.sort_by("home")
        back = [_unzip(x.as_py(), np.uint32, np.uint32) for x in s.column("blob")]
        types, all_pairs = s.column("totals")[0].as_py()
        start = np.concatenate([b[0] for b in back]).astype(np.int64)
        n_of = np.bincount(m.word, m.count, minlength=len(m.words)).astype(np.int64)
        guests_start = np.bincount(m.word, np.minimum(m.count, 1), minlength=len(m.words))
        hot = np.concatenate([b[1] for b in back])
        if len(hot):
            guests_start[0] = hot[0]
        share = deal.share(bucket)
        summed = np.zeros(len(m.pair), np.int64)
        sent, per_word, totals = [], [], [float((n_of > 0).sum()) if share == 1 else 0.0]
        for tables, upper in seatings(m.word, m.context, m.count, len(m.words), start, guests_start, types, all_pairs, bucket):
            summed += tables
            guests = np.bincount(m.word, tables, minlength=len(m.words))
            per_word += [guests.astype(np.uint32), (upper * share).astype(np.float32) if share < 1 else upper.astype(np.float32)]
            totals += [float(guests.sum()), float((upper * share).sum())]
            sent.append(np.bincount(m.context, tables, minlength=len(m.contexts)).astype(np.uint32))
        totals.append(float(n_of.sum()))
        rows, a, b = [], 0, 0
        pairs_n, pairs_t = m.count.astype(np.uint32), summed.astype(np.uint32)
        for k, (words_in, pairs_in) in enumerate(zip(m.words_in, m.pairs_in, strict=True)):
            w, p = m.of_word[a : a + words_in], m.of_pair[b : b + pairs_in]
            rows.append(_zip(m.many[a : a + words_in], n_of[w].astype(np.uint64), pairs_n[p], pairs_t[p], *(x[w] for x in per_word)))
            a, b = a + words_in, b + pairs_in
        at = home(m.contexts, n).astype(np.int64)
        cuts = runs(at)
        some = [_zip(m.contexts[x:z], *(y[x:z] for y in sent)) for x, z in cuts]
        return pa.table({
            "slice": pa.array([*m.slice.to_pylist(), -1, *[-2] * len(cuts)], pa.int64()), "place": pa.array([*m.run.to_pylist(), bucket, *(int(at[x]) for x, _ in cuts)], pa.int64()),
            "hot": pa.array([bucket if bucket >= n else -1] * (len(rows) + 1 + len(cuts)), pa.int64()),
            "blob": pa.array([*rows, None, *some], pa.binary()), "totals": pa.array([None] * len(rows) + [totals] + [None] * len(cuts), pa.list_(pa.float64())),
        })

    return parts.groupBy("bucket").cogroup(starts.groupBy("bucket")).applyInArrow(run, "slice long, place long, hot long, blob binary, totals array<double>")


def context_tables(parts: DataFrame, back: DataFrame, buckets: int) -> DataFrame:
    """Rows (slice, place, hot, blob): the tables of the restaurants of each slice's words, by home; places are negative."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                key = _unzip(w, np.uint64)[0] >> _SHORT
                at = home(key, buckets).astype(np.int64)
                cuts = runs(at)
                six = lambda a, z: np.ascontiguousarray(np.diff(key[a:z], prepend=np.uint64(0))).view(np.uint8).reshape(-1, 8)[:, :6].T.ravel()
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(cuts), pa.int64()), pa.array([int(at[a]) for a, _ in cuts], pa.int64()), pa.array([_zip(six(a, z)) for a, z in cuts], pa.binary())], names=["slice", "home", "blob"])

    def run(t: pa.Table, s: pa.Table) -> pa.Table:
        got = [_unzip(x.as_py(), np.uint64, *[np.uint32] * SAMPLES) for x in s.column("blob")]
        known, of = np.unique(np.concatenate([np.zeros(0, np.uint64), *(g[0] for g in got)]), return_inverse=True)
        sums = [np.append(np.bincount(of, np.concatenate([np.zeros(0), *(g[k + 1] for g in got)]), minlength=len(known)), 0) for k in range(SAMPLES)]
        blobs = []
        for x in t.column("blob"):
            six = _unzip(x.as_py(), np.uint8)[0].reshape(6, -1)
            gap = np.zeros((six.shape[1], 8), np.uint8)
            gap[:, :6] = six.T
            key = np.cumsum(gap.view(np.uint64).ravel())
            at = np.searchsorted(known, key)
            at = np.where(np.append(known, np.uint64(0))[at] == key, at, len(known))
            blobs.append(_zip(*(y[at].astype(np.uint32) for y in sums)))
        # Homes ascend with the words: the places -buckets, ..., -1 stand in the words' order.
        return pa.table({"slice": t.column("slice"), "place": pa.array([h - buckets for h in t.column("home").to_pylist()], pa.int64()), "hot": pa.array([-1] * len(blobs), pa.int64()), "blob": pa.array(blobs, pa.binary())})

    asked = parts.select("slice", "words").mapInArrow(tidy(ask), "slice long, home long, blob binary")
    sent = back.where("slice = -2").select(F.col("place").alias("home"), "blob")
    return asked.groupBy("home").cogroup(sent.groupBy("home")).applyInArrow(run, "slice long, place long, hot long, blob binary")


def _scores(t: pa.Table, types: float, train_tokens: int, samples: np.ndarray, first: np.ndarray, wide: np.ndarray) -> pa.Table:
    """The result rows of one slice, from its texts (place null) and all answers to it.

    first: the first bucket of each hot word; wide: its customers, tables and count over all its buckets.
    """
    place = t.column("place").to_numpy(zero_copy_only=False).astype(float)
    blob, hot = t.column("blob").to_pylist(), t.column("hot").to_pylist()
    order = np.argsort(np.nan_to_num(place, nan=-np.inf), kind="stable")
    word, per, ids, null, _ = _texts(blob[order[0]])
    rooms = [_unzip(blob[i], *[np.uint32] * SAMPLES) for i in order if place[i] < 0]
    got = [(_unzip(blob[i], np.uint32, np.uint64, np.uint32, np.uint32, *[np.uint32, np.float32] * SAMPLES), hot[i]) for i in order if place[i] >= 0]
    # Runs stand in the order of the words; those of one hot word follow each other and share it.
    of_word, last, n, hot_at, hot_is = [], -1, 0, [], []
    for g, h in got:
        group = int(np.searchsorted(first, h, "right")) - 1 if h >= 0 else -1
        same = group >= 0 and group == last
        if group >= 0 and not same:
            hot_at.append(n)
            hot_is.append(group)
        of_word.append(np.arange(len(g[0])) + n - same)
        n, last = n + len(g[0]) - same, group
    every = np.concatenate(of_word)

    def add(k: int, column: int) -> np.ndarray:
        out = np.bincount(every, np.concatenate([g[k] for g, _ in got]), minlength=n)
        if hot_at:  # a slice may not ask all buckets of a hot word
            out[hot_at] = wide[hot_is, column]
        return out

    total = add(1, -1)
    of = np.repeat(every, np.concatenate([g[0] for g, _ in got]))
    count, tables = (np.concatenate([g[k] for g, _ in got]).astype(float) for k in (2, 3))
    # Every word but the end is followed once wherever it occurs, and an end opens a text: a word is its context's customers.
    end_word = word[int(per[0]) - 1]
    keys, inverse = np.unique(word * n + np.append(end_word, word[:-1]), return_inverse=True)
    prev = keys % n
    chance = np.zeros(len(keys))
    for k, (guests, upper) in enumerate(samples):
        parent = (add(4 + 2 * k, 2 * k) - BASE_DISCOUNT * add(5 + 2 * k, 2 * k + 1) + (BASE_STRENGTH + BASE_DISCOUNT * upper) / (types + 1)) / (BASE_STRENGTH + guests)
        room = np.concatenate([r[k] for r in rooms]).astype(float)
        chance += ((STRENGTH + DISCOUNT * room) / (STRENGTH + total))[prev] * parent[of]
    chance = (chance + (count * SAMPLES - DISCOUNT * tables) / (STRENGTH + total)[prev]) / SAMPLES
    begin = np.cumsum(per) - per
    gather = lambda x: np.add.reduceat(x, begin)
    named = [None if no else int(i) for i, no in zip(ids, null, strict=True)]
    base = np.log10((total + 1) / (train_tokens + types + 1))
    return pa.table({
        "doc_id": pa.array(named, pa.int64()), "held_out": pa.array([held_out(i) for i in named]), "n_tokens": pa.array(per), "n_known": pa.array(gather((total > 0)[word].astype(np.int64))),
        "train_tokens": pa.array(np.full(len(per), train_tokens)), "base_score": pa.array(gather(base[word])), "score": pa.array(gather(np.log10(chance)[inverse])),
    })


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, least_buckets: int = 6, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = src.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    parts = written(cut(src), "slices")
    train_tokens = parts.agg(F.sum("train_tokens")).first()[0]
    if train_tokens is None:
        return docs.sparkSession.createDataFrame([], schema)
    wide = parts.select(F.explode("hot").alias("h")).groupBy("h.word").agg(F.sum("h.pairs").alias("n")).where(F.col("n") >= hot_pairs).collect()
    deal = Deal(max(least_buckets, -(-int(size) // bucket_bytes)), {r["word"] % 2**64: 1 + -(-int(r["n"]) // hot_pairs) for r in wide})
    sent = pairs(parts, deal)
    back = written(answers(sent, followers(sent, deal), deal), "answers")
    sums = {r["pos"]: r["x"] for r in back.where("slice = -1").select(F.posexplode("totals").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x")).collect()}
    flat = np.array([sums[k] for k in range(len(sums))])
    samples, first = flat[1:-1].reshape(SAMPLES, 2), deal.first
    # The buckets of each hot word together; it counts as one word, if any of them has seen it in training.
    wide = np.zeros((len(deal.hot), 2 * SAMPLES + 1))
    for r in back.where("slice = -1 AND hot >= 0").select("hot", "totals").collect() if len(deal.hot) else []:
        wide[np.searchsorted(first, r["hot"], "right") - 1] += np.array(r["totals"][1:])
    types = round(float(flat[0])) + int((wide[:, -1] > 0).sum())
    texts = parts.select("slice", F.lit(None).cast("long").alias("place"), F.lit(-1).cast("long").alias("hot"), F.col("texts").alias("blob"))
    both = texts.unionByName(back.where("slice >= 0").drop("totals")).unionByName(context_tables(parts, back, deal.buckets))

    def run(t: pa.Table) -> pa.Table:
        return _scores(t, types, train_tokens, samples, first, wide)

    return both.groupBy("slice").applyInArrow(run, schema)
