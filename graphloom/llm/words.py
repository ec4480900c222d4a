"""Encoding a batch of texts by its distinct words.

Where no two white spaces stand side by side, a space always starts a new piece
of a byte-level pre-tokenizer, so the words between spaces are independent. A
batch's words are told apart by Arrow's dictionary encoding, each distinct one
is encoded once, and the ids of the texts are put together by gathering from
one pool. Memory is bounded by a batch, or by a group of its texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Output parts hold about so many ids, or one text.
PART_IDS = 500_000
#: Words, and characters of whole texts, that are encoded in one call.
WORDS, WHOLE = 8_000, 500_000
#: Texts that are Python strings at a time.
TEXTS = 256
#: Words that an encoder holds from one group to the next; longer ones only for one call.
HELD, HELD_BYTES = 300_000, 64
_UNEVEN = regex.compile(r"\s\s")


def encode_texts(
    texts: pa.Array | list[str | None],
    specials: list[str],
    encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]],
    encode_whole: Callable[[list[str]], list[np.ndarray]],
    tail: tuple[int, ...] = (),
    group_bytes: int = 6 << 20,
    words_bound: int = WORDS,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of texts, offsets, ids) of consecutive parts of ``texts``; null counts as empty.

    ``group_bytes``: of texts whose words are told apart together.
    ``words_bound``: words that ``encode_words`` gets at once.
    """
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.cumsum(sizes), 0
    while at < len(column):
        before = total[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(total, before + group_bytes, "right")))
        yield from _encode_group(column.slice(at, to - at), specials, encode_words, encode_whole, tail, words_bound)
        at = to


def _encode_group(column, specials, encode_words, encode_whole, tail, words_bound):
    """As ``encode_texts``, of one group of texts.

    ``encode_words`` gives the ids of words, each with a space before it and
    ending in no white space, and how many ids each has; ``encode_whole`` those
    of texts of any kind. ``tail`` follows each text's ids.
    """
    entry, firsts, stops, starts, sizes, pool = _pooled(column, specials, encode_words, encode_whole, tail, words_bound)
    length = np.add.reduceat(sizes[entry], firsts, dtype=np.int64)
    total = np.cumsum(length)
    at = 0
    while at < len(column):
        before = total[at] - length[at]
        to = max(at + 1, int(np.searchsorted(total, before + PART_IDS, "right")))
        part = entry[firsts[at] : stops[to - 1]]
        yield to - at, np.concatenate(([0], total[at:to] - before)).astype(np.int32), gathered(pool, starts[part], sizes[part])
        at = to


def _pooled(column, specials, encode_words, encode_whole, tail, words_bound):
    """A group's texts as entries of a pool of ids: text k is entries ``firsts[k]`` to ``stops[k]``, entry e the ids from ``starts[e]``, ``sizes[e]`` of them.

    Python's strings of the texts are made some at a time, and what only the
    pool is made from is gone when it is returned.
    """
    heads, lists = [], []
    for at in range(0, len(column), TEXTS):
        bodies = []
        for t in column.slice(at, TEXTS).to_pylist():
            cut = -1 if not t or _UNEVEN.search(t) or any(s in t for s in specials) else t.find(" ")
            heads.append((t or "") if cut < 0 else t[:cut])
            bodies.append(None if cut < 0 else t[cut + 1 :])
        lists.append(pc.split_pattern(pa.array(bodies, pa.string()), " "))
    n_words = np.concatenate([pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in lists]).astype(np.int64)
    coded = pa.chunked_array([x.flatten() for x in lists], pa.string()).dictionary_encode().unify_dictionaries()
    del bodies, lists
    words = coded.chunk(0).dictionary.to_pylist() if coded.num_chunks else []
    indices = np.concatenate([np.zeros(0, np.int32), *(x.indices.to_numpy() for x in coded.chunks)])
    del coded
    ending = [k for k, w in enumerate(words) if not w or w[-1].isspace()]  # the last of a text
    last = set(ending)
    inner = [k for k in range(len(words)) if k not in last] if last else range(len(words))

    # The pool: words, words at the end of a text, what stands before a text's first space, the tail.
    pool, sizes = [], np.zeros(len(words) + len(column) + 1, dtype=np.int32)
    order = np.array([*inner, *ending, *range(len(words), len(sizes))], dtype=np.int32)
    for at in range(0, len(inner), words_bound):
        group = inner[at : at + words_bound]
        ids, n = encode_words([words[k] for k in group])
        pool.append(ids)
        sizes[group] = n
    alone = _in_turns(encode_whole, [" " + words[k] for k in ending] + heads)
    alone.append(np.array(tail, dtype=np.int32))
    sizes[order[len(inner) :]] = [len(x) for x in alone]
    pool = np.concatenate([*pool, *alone])
    starts = np.empty(len(sizes), dtype=np.int64)
    starts[order] = np.cumsum(sizes[order], dtype=np.int64) - sizes[order]

    # A text is its head, its words, and the tail: entries of the pool, one after another.
    stops = np.cumsum(n_words + 2)
    firsts = stops - n_words - 2
    entry = np.full(stops[-1], len(sizes) - 1, dtype=np.int32)
    between = np.ones(len(entry), dtype=bool)
    between[stops - 1] = between[firsts] = False
    entry[between] = indices
    entry[firsts] = len(words) + np.arange(len(column))
    return entry, firsts, stops, starts, sizes, pool


def _in_turns(encode_whole, texts):
    """The ids of ``texts``, ``WHOLE`` characters or one text in a call: what the encoder holds for a text is many times its ids."""
    out, at, held = [], 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= WHOLE or k + 1 == len(texts):
            out += encode_whole(texts[at : k + 1])
            at, held = k + 1, 0
    return out


def gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` at ``starts``, one after another."""
    return pool[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


class Recent:
    """``encode_words`` that takes the ids of words of its last calls from what it holds.

    It holds the last call's words, and of those before, the last ones of at most
    ``HELD_BYTES`` as far as they make no more than ``limit`` together, in Arrow's
    arrays; results do not depend on it.
    """

    def __init__(self, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 0):
        self.encode_words, self.limit = encode_words, limit
        self.words, self.ids = pa.array([], pa.string()), np.zeros(0, np.int32)
        self.starts = self.sizes = np.zeros(0, np.int32)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        column = pa.array(words, pa.string())
        place = pc.fill_null(pc.index_in(column, value_set=self.words), -1).to_numpy()
        new, old = np.flatnonzero(place < 0), np.flatnonzero(place >= 0)
        sizes, starts, parts = np.empty(len(words), np.int32), np.empty(len(words), np.int32), [self.ids]
        sizes[old], starts[old] = self.sizes[place[old]], self.starts[place[old]]
        for at in range(0, len(new), WORDS):
            group = new[at : at + WORDS]
            ids, sizes[group] = self.encode_words([words[k] for k in group])
            parts.append(ids)
        starts[new] = len(self.ids) + np.cumsum(sizes[new]) - sizes[new]
        ids = gathered(np.concatenate(parts), starts, sizes)
        self._hold(column, ids, sizes, place[old])
        return ids, sizes

    def _hold(self, column: pa.Array, ids: np.ndarray, sizes: np.ndarray, used: np.ndarray) -> None:
        left = pc.less_equal(pc.binary_length(self.words), HELD_BYTES).to_numpy(zero_copy_only=False).copy()
        left[used] = False
        rest = np.flatnonzero(left)[: max(0, self.limit - len(column))]
        self.words = pa.concat_arrays([column, self.words.take(pa.array(rest))])
        self.ids = np.concatenate([ids, gathered(self.ids, self.starts[rest], self.sizes[rest])])
        self.sizes = np.concatenate([sizes, self.sizes[rest]])
        self.starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)
