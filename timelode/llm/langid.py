"""Language identification, word by word, with a linear-chain conditional random field.

Words are runs of ASCII letters and of bytes beyond ASCII, lower-cased. A word's potential for each language is the sum of learned weights of
its affixes, its character n-grams and its own form (the lexicon), hashed into a fixed table; learned
transitions couple neighbours, so that a word which could be of several languages follows its context and
code-switched text is labelled piece by piece. Probabilities come from forward-backward over the whole
text. A text's language is the one with the greatest mean probability over its words, which is the score.

Long texts cost no long loops: words are laid out in blocks, each block's product of transition matrices is
taken for all blocks of a batch at once, the products are chained along each text, and the blocks are then
filled in, again all at once. The outcome is that of word-by-word recursions. With MANY languages, where those
products would cost more, the recursions of many texts run side by side. Slices of texts shrink as languages
grow, so that the memory of a slice stays. A text of more than SEGMENT words (fewer with many languages) is walked twice, segment by segment, with messages from its other segments.

Learning takes windows of WINDOW words from all over the sampled texts, on the executors, and of each language
the SAMPLE_WINDOWS with the least hashes; only they reach the driver.

Cases: texts that are null or hold no letter are `und` with score 0, and so are all texts when there is
nothing to learn from; equal windows of a language count once, however often their rows are repeated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timelode.llm._common import SLICE_BYTES, bucket_of, lean, small_arrow, small_batches, table, text_slices, written
from timelode.llm._words import _BYTE, NOT_LETTER, Words, _power, mix, scan

BITS = 16
#: Texts whose windows are drawn from, about so many for each language, chosen by a hash of their id; windows of each language at most.
SAMPLE_PER_LANGUAGE, SAMPLE_WINDOWS = 500, 3000
#: Windows of all languages at most: with many languages each has fewer. Weights of all languages at most: with over 256 languages features share them.
ALL_WINDOWS, ALL_WEIGHTS = 400_000, 1 << 24
#: From so many languages on, words are walked one after another, as products of transitions would cost more.
MANY = 16
#: Words of a training window.
WINDOW = 40
#: Words of a text that are looked at together.
SEGMENT = 1 << 16
EPOCHS, RATE, DECAY, BATCH = 4, 0.3, 1e-6, 64
BLOCK = 32
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


def distinct_words(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, which): the distinct words of a slice, and which of them each word is."""
    _, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
    return words.starts[first], words.ends[first], which


def bits_for(languages: int) -> int:
    """How many bits of a feature's hash tell its weights, given the number of languages."""
    return min(BITS, max(8, (ALL_WEIGHTS // max(1, languages)).bit_length() - 1))


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(features, word they are of), in word order: prefixes and suffixes of 1-4 bytes, n-grams of 2-4 bytes, the word itself."""
    up, down = _power(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    piece = lambda a, b, kind: mix(((sums[b] - sums[a]) * down[a]) ^ np.uint64(kind << 8), 11) >> np.uint64(64 - bits)
    n, word = ends - starts, np.arange(len(starts))
    out, owner = [piece(starts, ends, 0)], [word]
    for k in (1, 2, 3, 4):
        long = n >= k
        s, e = starts[long], ends[long]
        out += [piece(s, s + k, k), piece(e - k, e, 16 + k)]
        owner += [word[long], word[long]]
        if k > 1:
            count = np.maximum(n - k + 1, 0)
            w = np.repeat(word, count)
            at = np.arange(len(w)) - np.repeat(np.cumsum(count) - count, count) + starts[w]
            out.append(piece(at, at + k, 32 + k))
            owner.append(w)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(out).astype(np.int64)[order], owner[order]


@dataclass
class Field:
    """Languages, weights [features, languages] and transitions [languages, languages]."""

    languages: list[str]
    weight: np.ndarray
    transition: np.ndarray

    @property
    def bits(self) -> int:
        return len(self.weight).bit_length() - 1

    def portion(self, size: int) -> int:
        """What of a size, meant for up to four languages, keeps the memory of more languages as it is."""
        return max(1, size * 4 // max(4, len(self.languages)))

    def potentials(self, words: Words) -> np.ndarray:
        """[words, languages] log potentials."""
        starts, ends, which = distinct_words(words)
        feature, owner = word_features(words.data, starts, ends, self.bits)
        sums = np.add.reduceat(self.weight[feature], np.searchsorted(owner, np.arange(len(starts)))) / np.sqrt(np.bincount(owner))[:, None]
        return sums[which]

    def _laid_out(self, potentials: np.ndarray, first: np.ndarray):
        """(grid, there, row, col, first block, products): words in blocks, and the product of each block's transitions."""
        move = np.exp(self.transition)
        e = np.exp(potentials - potentials.max(axis=1, keepdims=True))
        count, labels = np.diff(first), e.shape[1]
        first_block = np.concatenate([[0], np.cumsum(-(-count // BLOCK))])
        seq = np.repeat(np.arange(len(count)), count)
        nth = np.arange(len(seq)) - first[:-1][seq]
        row, col = first_block[:-1][seq] + nth // BLOCK, nth % BLOCK
        total = int(first_block[-1])
        grid, there = np.ones((total, BLOCK, labels)), np.zeros((total, BLOCK), bool)
        grid[row, col], there[row, col] = e, True
        product = np.broadcast_to(np.eye(labels), (total, labels, labels)).copy()
        for t in range(BLOCK):
            step = _unit((product @ move) * grid[:, t, None, :], (1, 2))
            product = np.where(there[:, t, None, None], step, product)
        return grid, there, row, col, first_block, product

    def product(self, potentials: np.ndarray) -> np.ndarray:
        """The product of all transitions of one sequence, up to a factor."""
        *_, product = self._laid_out(potentials, np.array([0, len(potentials)]))
        out = product[0]
        for p in product[1:]:
            out = _unit(out @ p, (0, 1))
        return out

    def marginals(self, potentials: np.ndarray, first: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
        """[words, languages] probabilities by forward-backward over the sequences first[i]:first[i+1]; before and after are messages from beyond their ends."""
        move = np.exp(self.transition)
        if len(move) >= MANY:
            return self._walked(potentials, first, before, after)
        grid, there, row, col, first_block, product = self._laid_out(potentials, first)
        total, labels, blocks = len(grid), grid.shape[2], np.diff(first_block)
        enter, leave = np.full((total, labels), 1 / labels), np.full((total, labels), 1 / labels)
        if before is not None:
            enter[first_block[:-1]] = before
        if after is not None:
            leave[first_block[1:] - 1] = after
        for k in range(1, int(blocks.max(initial=0))):
            b = first_block[:-1][blocks > k] + k
            enter[b] = _unit(np.einsum("bi,bij->bj", enter[b - 1], product[b - 1]), 1)
            b = first_block[1:][blocks > k] - 1 - k
            leave[b] = _unit(np.einsum("bij,bj->bi", product[b + 1], leave[b + 1]), 1)
        ahead, back = np.empty_like(grid), np.empty_like(grid)
        a, z = enter, leave
        for t in range(BLOCK):
            a = _unit((a @ move) * grid[:, t], 1)
            ahead[:, t] = a
            u = BLOCK - 1 - t
            back[:, u] = z
            z = np.where(there[:, u, None], _unit((grid[:, u] * z) @ move.T, 1), z)
        return _unit(ahead[row, col] * back[row, col], 1)

    def _walked(self, potentials: np.ndarray, first: np.ndarray, before: np.ndarray | None, after: np.ndarray | None) -> np.ndarray:
        """marginals() word after word, for all sequences at once, sequences of like length together."""
        move, labels = np.exp(self.transition), potentials.shape[1]
        e = np.exp(potentials - potentials.max(axis=1, keepdims=True))
        n, out = np.diff(first), np.empty_like(e)
        order = np.argsort(n, kind="stable")[np.count_nonzero(n == 0) :]
        for k in range(0, len(order), 64):
            own = order[k : k + 64]
            long, at = int(n[own].max()), first[:-1][own]
            a = np.full((len(own), labels), 1 / labels) if before is None else np.repeat(before[None], len(own), 0)
            z = np.full((len(own), labels), 1 / labels) if after is None else np.repeat(after[None], len(own), 0)
            for t in range(long):
                live = np.flatnonzero(n[own] > t)
                a[live] = _unit((a[live] @ move) * e[at[live] + t], 1)
                out[at[live] + t] = a[live]
            for t in reversed(range(long)):
                live = np.flatnonzero(n[own] > t)
                here = at[live] + t
                out[here] = _unit(out[here] * z[live], 1)
                z[live] = _unit((e[here] * z[live]) @ move.T, 1)
        return out

    def passed(self, potentials: np.ndarray, message: np.ndarray, back: bool = False) -> np.ndarray:
        """A message handed on through one sequence, from its start to its end or back."""
        move, e = np.exp(self.transition), np.exp(potentials - potentials.max(axis=1, keepdims=True))
        for row in e[::-1] if back else e:
            message = move @ (row * message) if back else (message @ move) * row
            message = message / message.sum()
        return message

    def long_sum(self, words: Words) -> np.ndarray:
        """The sum of the words' probabilities of one long text, segment by segment."""
        cut = [*range(0, len(words.starts), self.portion(SEGMENT)), len(words.starts)]
        parts = [words.between(a, b) for a, b in zip(cut, cut[1:], strict=False)]
        labels = len(self.languages)
        even = np.full(labels, 1 / labels)
        if labels >= MANY:
            before, after = [even], [even]
            for p in parts[:-1]:
                before.append(self.passed(self.potentials(p), before[-1]))
            for p in parts[:0:-1]:
                after.append(self.passed(self.potentials(p), after[-1], True))
            return sum(self.marginals(self.potentials(p), np.array([0, len(p.starts)]), x, y).sum(axis=0) for p, x, y in zip(parts, before, after[::-1], strict=True))
        products = [self.product(self.potentials(p)) for p in parts]
        before, after = [even], [even]
        for p in products[:-1]:
            before.append(_unit(before[-1] @ p, 0))
        for p in products[:0:-1]:
            after.append(_unit(p @ after[-1], 0))
        return sum(self.marginals(self.potentials(p), np.array([0, len(p.starts)]), x, y).sum(axis=0) for p, x, y in zip(parts, before, after[::-1], strict=True))


def _unit(x: np.ndarray, axes) -> np.ndarray:
    return x / x.sum(axis=axes, keepdims=True)


def learn(texts: list[str], langs: list[str], seed: int = 5) -> Field:
    """Fit a field by Adagrad on the conditional likelihood of windows, half of them spliced from two texts so that languages switch."""
    languages = sorted(set(langs))
    label = {k: i for i, k in enumerate(languages)}
    count, rng = len(languages), np.random.default_rng(seed)
    field = Field(languages, np.zeros((1 << bits_for(count), count), np.float32), np.zeros((count, count)))
    windows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []
    column = pc.utf8_lower(pa.array(texts, pa.string()))
    for i, _, data, offsets in text_slices(column):
        words = scan(data, offsets, parts=NOT_LETTER)
        if not len(words.starts):
            continue
        starts, ends, which = distinct_words(words)
        feature, owner = word_features(words.data, starts, ends, field.bits)
        at = np.searchsorted(owner, np.arange(len(starts) + 1))
        for d in range(len(offsets) - 1):
            a, b = words.first[d : d + 2]
            for s in range(a, b, WINDOW):
                windows.append((feature, at, which[s : min(b, s + WINDOW)], label[langs[i + d]]))
    square_w, square_t = np.full_like(field.weight, 1e-3), np.full_like(field.transition, 1e-3)
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        partner = rng.permutation(len(windows))
        for k in range(0, len(order), BATCH):
            feats, sizes, gold, lengths = [], [], [], []
            for r, q in zip(order[k : k + BATCH].tolist(), partner[k : k + BATCH].tolist(), strict=False):
                pieces = [windows[r]]
                if r % 2:
                    pieces = [(*windows[r][:2], windows[r][2][: WINDOW // 2], windows[r][3]), (*windows[q][:2], windows[q][2][: WINDOW // 2], windows[q][3])]
                lengths.append(sum(len(p[2]) for p in pieces))
                for feature, at, w, y in pieces:
                    n = at[w + 1] - at[w]
                    feats.append(feature[np.repeat(at[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
                    sizes.append(n)
                    gold.append(np.full(len(w), y))
            f, n, y = np.concatenate(feats), np.concatenate(sizes), np.concatenate(gold)
            scale = 1 / np.sqrt(n)
            word = np.repeat(np.arange(len(n)), n)
            potential = np.add.reduceat(field.weight[f], np.cumsum(n) - n) * scale[:, None]
            first = np.concatenate([[0], np.cumsum(lengths)])
            unary, pair = _expected(field, potential, first)
            error = unary
            error[np.arange(len(y)), y] -= 1
            # Only the features of the batch have a gradient.
            rows, at = np.unique(f, return_inverse=True)
            flat = np.zeros((len(rows), count))
            np.add.at(flat, at, (error * scale[:, None])[word])
            inner = np.ones(len(y), bool)
            inner[first[:-1]] = False
            at = np.flatnonzero(inner)
            np.add.at(pair, (y[at - 1], y[at]), -1)
            flat, pair = flat / BATCH, pair / BATCH
            square_w[rows] += flat * flat
            field.weight[rows] -= RATE * (flat / np.sqrt(square_w[rows]) + DECAY * field.weight[rows])
            square_t += pair * pair
            field.transition -= RATE * (pair / np.sqrt(square_t) + DECAY * field.transition)
    return field


def _expected(field: Field, potential: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word probabilities, and the expected number of each transition, of short sequences, padded to one length."""
    move, count = np.exp(field.transition), len(field.languages)
    n = np.diff(first)
    seq = np.repeat(np.arange(len(n)), n)
    col = np.arange(len(seq)) - first[:-1][seq]
    long = int(n.max())
    grid = np.ones((len(n), long, count))
    grid[seq, col] = np.exp(potential - potential.max(axis=1, keepdims=True))
    there = np.arange(long) < n[:, None]
    ahead, back = np.empty_like(grid), np.empty_like(grid)
    a, z = np.full((len(n), count), 1 / count), np.ones((len(n), count))
    for t in range(long):
        a = (a @ move) * grid[:, t]
        a /= a.sum(axis=1, keepdims=True)
        ahead[:, t] = a
        u = long - 1 - t
        back[:, u] = z
        y = (grid[:, u] * z) @ move.T
        z = np.where(there[:, u, None], y / y.sum(axis=1, keepdims=True), z)
    unary = ahead * back
    unary /= unary.sum(axis=2, keepdims=True)
    right = grid[:, 1:] * back[:, 1:]
    # The sum of a pair's joint probabilities, and then all pairs as one matrix product.
    total = np.einsum("bti,ij,btj->bt", ahead[:, :-1], move, right, optimize=True)
    share = np.where(there[:, 1:], 1 / total, 0.0)
    return unary[seq, col], move * np.einsum("bti,btj->ij", ahead[:, :-1] * share[:, :, None], right, optimize=True)


def windows_of(texts: DataFrame) -> DataFrame:
    """(lang, window): the texts (lang, text) cut into windows of WINDOW words, lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            for i, j, data, offsets in text_slices(pc.utf8_lower(batch.column(1))):
                words = scan(data, offsets, lower=False, parts=NOT_LETTER)
                rows, found = [], []
                for d, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                    for s in range(a, b, WINDOW):
                        rows.append(i + d)
                        found.append(data[words.starts[s] : words.ends[min(b, s + WINDOW) - 1]].tobytes().decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], ["lang", "window"])

    return texts.select("lang", "text").mapInArrow(lean(run), "lang string, window string")


def fit(docs: DataFrame, train: Column | None = None, per_language: int = SAMPLE_PER_LANGUAGE, most: int = SAMPLE_WINDOWS) -> Field:
    """A field of a bounded sample of windows of the documents that meet train and name a language."""
    train = bucket_of() != 0 if train is None else train
    own = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    # One row for each language.
    counts = written(own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    languages = counts.count()
    if not languages:
        return Field([], np.zeros((1 << BITS, 0)), np.zeros((0, 0)))
    most = max(1, min(most, ALL_WINDOWS // languages))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    drawn = own.join(counts, "lang").filter(place * F.col("n") < per_language)
    windows = windows_of(drawn).distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("window"), "window"))
    with small_arrow(docs.sparkSession):
        some = windows.withColumn("nth", nth).filter(F.col("nth") <= most).select("lang", "window").toArrow()
    rows = sorted(zip(some["lang"].to_pylist(), some["window"].to_pylist(), strict=True))
    return learn([r[1] for r in rows], [r[0] for r in rows])


def _predict(field: Field, column: pa.Array) -> tuple[list[str], np.ndarray]:
    langs, scores = [], []
    lettered = np.asarray(pc.match_substring_regex(column, r"\p{L}"))
    lowered = pc.utf8_lower(column)
    for i, j, data, offsets in text_slices(lowered, field.portion(SLICE_BYTES)):
        words = scan(data, offsets, parts=NOT_LETTER)
        mean = np.zeros((j - i, max(1, len(field.languages))))
        if field.languages and j - i == 1 and len(words.starts) > field.portion(SEGMENT):
            mean[0] = field.long_sum(words) / len(words.starts)
        elif len(words.starts) and field.languages:
            p = field.marginals(field.potentials(words), words.first)
            some = np.flatnonzero(np.diff(words.first))
            mean[some] = np.add.reduceat(p, words.first[some]) / np.diff(words.first)[some, None]
        best = mean.argmax(axis=1)
        known = lettered[i:j] & (mean.max(axis=1) > 0)
        langs += [field.languages[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist(), strict=True)]
        scores.append(np.where(known, np.minimum(mean.max(axis=1), 1.0), 0.0))
    return langs, np.concatenate(scores) if scores else np.zeros(0)


def identified(docs: DataFrame, field: Field, text: str = "text") -> Column:
    """A struct column (lang, score) of a text column."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.arrow_udf("lang string, score double")
    @lean
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            langs, scores = _predict(shared.value, column)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return run(F.coalesce(F.col(text), F.lit("")))


def label_words(texts: list[str], field: Field) -> list[list[tuple[str, str]]]:
    """For each text, its words with the likeliest language of each: the field's view of code-switched text."""
    out: list[list[tuple[str, str]]] = []
    for _, _, data, offsets in text_slices(pc.utf8_lower(pa.array(texts, pa.string()))):
        words = scan(data, offsets, parts=NOT_LETTER)
        best = field.marginals(field.potentials(words), words.first).argmax(axis=1) if len(words.starts) else []
        raw = words.data.tobytes()
        for a, b in zip(words.first, words.first[1:], strict=False):
            out.append([(raw[words.starts[w] : words.ends[w]].decode("utf-8", "replace"), field.languages[best[w]]) for w in range(a, b)])
    return out


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the languages named outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    field = fit(docs)
    out = docs.select("doc_id", (F.coalesce(bucket_of(), F.lit(1)) == 0).alias("held_out"), identified(docs, field).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


QUERIES = {"op2_langid": op2_langid}
ORACLES: dict[str, str] = {}
