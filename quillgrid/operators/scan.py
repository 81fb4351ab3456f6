"""One pass over documents that meets them with all words of all queries, where the documents lie.

Documents come as Arrow batches (key, terms, parts): the tokens of the indexed fields in a row, and how many of them each field has. A batch is cut
into slices of about a million tokens; there, words are found as array work. Nothing of a document leaves its task but the places of stated words
(found), or its scores for the queries that keep it (met). A task holds one slice, the words, and k documents a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens that are worked on together.
TOKENS = 1 << 20
#: Numbers in the table of phrases by documents, and atoms of queries that are summed together.
CELLS, ATOMS = 1 << 21, 1 << 13
#: Candidates that wait before the best are taken.
WAITING = 1 << 17
GAP = 1 << 24


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        last = np.cumsum(np.asarray(batch.column("terms").value_lengths())) // TOKENS
        cuts = np.append(np.flatnonzero(last[1:] != last[:-1]) + 1, batch.num_rows)
        for first, end in zip(np.append(0, cuts[:-1]).tolist(), cuts.tolist()):
            if end > first:
                yield batch.slice(first, end - first)


class Phrases:
    """Distinct phrases, each a list of tokens, as numbers in their order."""

    def __init__(self, phrases: list[list[str]]) -> None:
        self.n = len(phrases)
        number = {t: i for i, t in enumerate(dict.fromkeys(t for p in phrases for t in p))}
        self.tokens = pa.array(list(number), pa.string())
        self.single = np.full(len(number), -1, np.int64)  # the phrase that a token is by itself
        self.several: list[tuple[int, np.ndarray]] = []
        for i, p in enumerate(phrases):
            if len(p) == 1:
                self.single[number[p[0]]] = i
            else:
                self.several.append((i, np.array([number[t] for t in p])))

    def places(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, phrase, field, position in the field) wherever a phrase begins, by row, phrase and position; and the rows' numbers of tokens."""
        size = np.asarray(batch.column("terms").value_lengths()).astype(np.int64)
        codes = batch.column("terms").flatten().dictionary_encode()
        of = pc.fill_null(pc.index_in(codes.dictionary, value_set=self.tokens), -1).to_numpy(zero_copy_only=False)
        ids = of[codes.indices.to_numpy(zero_copy_only=False)] if len(codes) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(size)), size)
        parts = np.asarray(batch.column("parts").flatten()).reshape(len(size), -1).astype(np.int64)
        ends = (np.cumsum(size) - size)[:, None] + np.cumsum(parts, axis=1)  # of the fields, in the slice
        field = np.zeros(len(row), np.int64)
        for k in range(parts.shape[1] - 1):
            field += np.arange(len(row)) >= ends[row, k]

        known = np.flatnonzero(ids >= 0)
        one = known[self.single[ids[known]] >= 0]
        start, phrase = [one], [self.single[ids[one]]]
        if self.several:
            order = known[np.argsort(ids[known], kind="stable")]
            first = np.searchsorted(ids[order], np.arange(len(self.tokens) + 1))
            count = np.diff(first)
            for i, toks in self.several:
                at = int(np.argmin(count[toks]))  # the rarest here
                t, k = int(toks[at]), len(toks)
                s = order[first[t] : first[t + 1]] - at
                s = s[(s >= 0) & (s + k <= len(ids))]
                for j in range(k):
                    if not len(s):
                        break
                    s = s[ids[s + j] == toks[j]] if j != at else s
                s = s[(row[s] == row[s + k - 1]) & (field[s] == field[s + k - 1])] if len(s) else s
                start.append(s)
                phrase.append(np.full(len(s), i))
        start, phrase = np.concatenate(start), np.concatenate(phrase)
        order = np.lexsort((start, phrase, row[start]))
        start, phrase = start[order], phrase[order]
        own = row[start]
        begin = np.concatenate([(np.cumsum(size) - size)[:, None], ends[:, :-1]], axis=1)
        return own, phrase, field[start], start - begin[own, field[start]], size


def _heads(row: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (phrase[1:] != phrase[:-1])
    return np.flatnonzero(new)


def found(phrases: Phrases, names: list[str], key: list[str]) -> Callable:
    """Rows (phrase, key, pos, dl); a position in the n-th field is n * GAP more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        called = pa.array(names, pa.string())
        for batch in slices(batches):
            row, phrase, field, pos, size = phrases.places(batch)
            head = _heads(row, phrase)
            own = pa.array(row[head])
            lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(row)), pa.int32()), pa.array(pos + field * GAP, pa.int32()))
            yield pa.RecordBatch.from_arrays([called.take(pa.array(phrase[head])), *(batch.column(k).take(own) for k in key), lists, pa.array(size[row[head]], pa.int32())], ["phrase", *key, "pos", "dl"])

    return run


def _weighted(phrases: Phrases, batch: pa.RecordBatch, weights: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, phrase, f) by row, where f is the sum of the weights of its places, and the rows' sizes."""
    row, phrase, field, _, size = phrases.places(batch)
    w = np.array(weights)[field]
    row, phrase, w = row[w > 0], phrase[w > 0], w[w > 0]
    head = _heads(row, phrase)
    return row[head], phrase[head], np.add.reduceat(w, head) if len(head) else w, size


def counted(phrases: Phrases, weights: list[float]) -> Callable:
    """Rows (phrase, n, tokens): in how many documents of a task each phrase is; phrase -1 has all documents and tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, tokens = np.zeros(phrases.n, np.int64), 0, 0
        for batch in slices(batches):
            _, phrase, _, size = _weighted(phrases, batch, weights)
            df += np.bincount(phrase, minlength=phrases.n)
            docs, tokens = docs + len(size), tokens + int(size.sum())
        own = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(own, -1)), pa.array(np.append(df[own], docs)), pa.array(np.append(df[own] * 0, tokens))], ["phrase", "n", "tokens"])

    return run


class Asked:
    """Queries as runs of phrase numbers, one for each atom; blocks of them are summed together."""

    def __init__(self, runs: list[list[int]]) -> None:
        self.size = np.array([len(r) for r in runs])
        self.blocks: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        first = 0
        while first < len(runs):
            last = first + max(1, int(np.searchsorted(np.cumsum(self.size[first:]), ATOMS, "right")))
            self.blocks.append((first, last, np.concatenate([np.array(r) for r in runs[first:last]]), np.concatenate([[0], np.cumsum(self.size[first:last])[:-1]]).astype(np.int64)))
            first = last


def met(phrases: Phrases, asked: Asked, key: list[str], weights: list[float], value: Callable | None, k: int | None, full_only: bool) -> Callable:
    """Rows (q, full, key, score, order, n_terms, n): what each query finds, all of it or the k best with all its words and the k best without.

    value(phrase, f, dl) is what a phrase adds to a score; without one, scores are 0. order is the score rounded, by which the best are chosen. With k,
    rows with n and no key tell how many documents a query found in the task.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_found = np.zeros((len(asked.size), 2), np.int64)
        least = np.full((len(asked.size), 2), -np.inf)  # the k-th best so far
        best: pa.Table | None = None
        wide = max(16, min(1024, CELLS // max(1, phrases.n)))

        def shown(batch: pa.RecordBatch, own: list) -> pa.Table:
            q, row, full, score, order, n = (np.concatenate(c) for c in zip(*own))
            take = pa.array(row)
            return pa.table([pa.array(q, pa.int32()), pa.array(full), *(batch.column(c).take(take) for c in key), pa.array(score), pa.array(order), pa.array(n, pa.int64()), pa.nulls(len(q), pa.int64())], ["q", "full", *key, "score", "order", "n_terms", "n"])

        def better(old: pa.Table | None, new: pa.Table) -> pa.Table:
            both = pa.concat_tables([old, new]) if old is not None else new
            both = both.take(pc.sort_indices(both, [("q", "ascending"), ("full", "ascending"), ("order", "descending"), *((c, "ascending") for c in key)]))
            group = both["q"].to_numpy().astype(np.int64) * 2 + both["full"].to_numpy()
            head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            place = np.arange(len(group)) - np.repeat(head, np.diff(np.append(head, len(group))))
            last = np.flatnonzero(place == k - 1)
            least[group[last] // 2, group[last] % 2] = both["order"].to_numpy()[last]
            return both.filter(pa.array(place < k)).combine_chunks()

        for batch in slices(batches):
            row, phrase, f, size = _weighted(phrases, batch, weights)
            part = value(phrase, f, size[row]) if value else np.ones(len(row))
            waiting, n_waiting = [], 0
            for a in range(0, batch.num_rows, wide):
                lo, hi = np.searchsorted(row, [a, a + wide])
                if lo == hi:
                    continue
                table = np.zeros((phrases.n, min(wide, batch.num_rows - a)))
                table[phrase[lo:hi], row[lo:hi] - a] = part[lo:hi]
                for first, last, cols, starts in asked.blocks:
                    own = table[cols]
                    n = np.add.reduceat(own > 0, starts, axis=0, dtype=np.int32)
                    full = n == asked.size[first:last, None]
                    hit = full if full_only else n > 0
                    if k:
                        n_found[first:last, 0] += (hit & ~full).sum(1)
                        n_found[first:last, 1] += (hit & full).sum(1)
                    if not hit.any():
                        continue
                    score = np.add.reduceat(own, starts, axis=0) if value else np.zeros(n.shape)
                    order = np.floor(score * 1e9 + 0.5) / 1e9
                    if k:
                        hit = hit & (order >= np.where(full, least[first:last, 1:], least[first:last, :1]))
                    q, d = np.nonzero(hit)
                    waiting.append((q + first, d + a, full[q, d], score[q, d], order[q, d], n[q, d]))
                    n_waiting += len(q)
                if n_waiting > WAITING:
                    if k:
                        best = better(best, shown(batch, waiting))
                    else:
                        yield from shown(batch, waiting).to_batches()
                    waiting, n_waiting = [], 0
            if n_waiting and k:
                best = better(best, shown(batch, waiting))
            elif n_waiting:
                yield from shown(batch, waiting).to_batches()
        if best is not None:
            yield from best.to_batches()
            q, full = np.nonzero(n_found)
            empty = [pa.nulls(len(q), best.schema.field(c).type) for c in key]
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(full == 1), *empty, pa.nulls(len(q), pa.float64()), pa.nulls(len(q), pa.float64()), pa.nulls(len(q), pa.int64()), pa.array(n_found[q, full])], ["q", "full", *key, "score", "order", "n_terms", "n"])

    return run
