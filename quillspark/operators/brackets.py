"""Bracketings of sentences to their nodes, on batches of sentences: each step is one pass over all brackets of a batch.

A row is a sentence with arrays of equal length, so nothing is shuffled or sorted by the engine; a task holds one batch, cut
into pieces of about ``WORDS`` words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import lexicons as L

#: Words of the sentences worked on at once; a longer sentence is a piece of its own.
WORDS = 1 << 15
#: A closing bracket, an opening one, and that of a word.
CLOSE, OPEN, LEAF = 0, 1, 2
MARK = re.compile(r"(\([^()*\s]+|\*|\))", re.ASCII)


def nodes(sents: DataFrame) -> DataFrame:
    """doc, sent, node, parent, label, depth, start, end, leaf, mirror, text, head of all nodes, as ``trees.constituents`` and
    ``trees.phrase_heads`` say. sents: doc, sent, places (word numbers, in order), tokens, tags, bits."""
    types = {f.name: f.dataType.simpleString() for f in sents.schema}
    place = types["places"].removeprefix("array<").removesuffix(">")
    schema = f"doc {types['doc']}, sent {types['sent']}, node int, parent int, label string, depth int, start {place}, end {place}, leaf boolean, mirror int, text string, head string"
    rows = sents.select("doc", "sent", "places", "tokens", "tags", "bits").where("doc is not null and sent is not null").where(F.size("bits") > 0)
    return rows.mapInArrow(_run, schema)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = np.cumsum(pc.list_value_length(batch.column("bits")).to_numpy(zero_copy_only=False))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(done, (done[low - 1] if low else 0) + WORDS, "right")))
            yield _piece(batch.slice(low, high - low))
            low = high


def _places(lengths: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each row, as many as its length."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) - np.repeat(before - begin, lengths)


def _piece(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = batch.num_rows
    size = pc.list_value_length(batch.column("bits")).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(size) - size
    sent_of = np.repeat(np.arange(rows), size)
    places = batch.column("places").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    tokens, tags = batch.column("tokens").flatten(), batch.column("tags").flatten()
    # brackets: few kinds of bits, many words
    bits = batch.column("bits").flatten().dictionary_encode()
    kinds: list[int] = []
    names: list[int] = []
    labels: dict[str, int] = {}
    ends = [0]
    for b in bits.dictionary.to_pylist():
        for m in MARK.findall(b):
            kinds += [LEAF, CLOSE] if m == "*" else [CLOSE] if m == ")" else [OPEN]
            names += [0, 0] if m == "*" else [0] if m == ")" else [labels.setdefault(m[1:], len(labels))]
        ends.append(len(kinds))
    code = bits.indices.fill_null(len(ends) - 1).to_numpy(zero_copy_only=False)
    first, many = np.array(ends), np.diff([*ends, ends[-1]])
    at = _places(many[code], first[code])
    kind, name = np.array(kinds, np.int64)[at], np.array(names, np.int64)[at]
    word = np.repeat(np.arange(len(code)), many[code])
    sent = sent_of[word]
    n = len(kind)
    # levels; an opening and the next bracket of its level are one node
    step = np.where(kind == CLOSE, -1, 1)
    run = np.concatenate([[0], np.cumsum(step)])
    level = run[1:] - run[np.searchsorted(sent, sent)] + (kind == CLOSE)
    low = int(level.min(initial=1)) - 1
    wide = int(level.max(initial=1)) - low + 1
    group = sent * wide + level - low
    order = np.argsort(group, kind="stable")
    close = np.full(n, -1)
    close[order[:-1]] = np.where(group[order[1:]] == group[order[:-1]], order[1:], -1)
    ev = np.flatnonzero((kind != CLOSE) & (close >= 0))
    ev_end, leaf, of, level = close[ev], kind[ev] == LEAF, sent[ev], level[ev]
    count = len(ev)
    before = np.searchsorted(of, of)
    node = np.arange(count) - before + 1
    mirror = np.empty(count, np.int64)
    turned = np.lexsort((-ev_end, of))
    mirror[turned] = node
    # parents: the last node a level up that began before, if it ends after
    key = group[ev] * (n + 1) + ev
    by_key = np.argsort(key)
    up = by_key[np.maximum(np.searchsorted(key[by_key], key - (n + 1)) - 1, 0)] if count else np.zeros(0, np.int64)
    ok = (of[up] == of) & (level[up] == level - 1) & (ev[up] < ev) & (ev_end[up] > ev_end) & ~leaf[up]
    parent = np.where(ok, up, -1)
    # texts
    start, end = places[word[ev]], places[word[ev_end]]
    left = np.clip(start, 0, size[of])
    right = np.clip(end + 1, left, size[of])
    left, right = left + begin[of], right + begin[of]
    spans = _places(right - left, left)
    known = tokens.is_valid().to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(known[spans])])[np.concatenate([[0], np.cumsum(right - left)])]
    spans = spans[known[spans]]
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens.take(pa.array(spans))), " ")
    label = pa.concat_arrays([pa.array(list(labels), pa.string()), tags.cast(pa.string())]).take(pa.array(np.where(leaf, len(labels) + word[ev], name[ev])))
    # heads: the last noun child; else by the last noun phrase child; else the last noun; else the last word
    nominal = pc.is_in(tags, pa.array(L.NOUN_TAGS, tags.type)).to_numpy(zero_copy_only=False)
    noun, phrase = np.full(count, -1), np.full(count, -1)
    kid = np.flatnonzero(ok & leaf & nominal[word[ev]])
    np.maximum.at(noun, parent[kid], kid)
    kid = np.flatnonzero(ok & ~leaf & pc.equal(label, "NP").fill_null(False).to_numpy(zero_copy_only=False))
    np.maximum.at(phrase, parent[kid], kid)
    last = np.maximum.accumulate(np.where(nominal & known, np.arange(len(nominal)), -1))
    final = last[np.maximum(right - 1, 0)]
    final = np.where(right <= left, -1, np.where(final >= left, final, right - 1))
    # the text of a child without a token is empty
    head = np.where(noun >= 0, np.where(known[left[noun]], left[noun], len(known)) if count else noun, np.where(phrase >= 0, -1, final))
    follow = np.where(noun >= 0, -1, phrase)
    while len(open_ := np.flatnonzero((head < 0) & (follow >= 0))):
        to = follow[open_]
        head[open_], follow[open_] = head[to], follow[to]
    heads = pa.concat_arrays([tokens, pa.array([""], tokens.type)]).take(pa.array(head, mask=head < 0))
    whole = lambda x, t=pa.int32(), mask=None: pa.array(x, t, mask=mask)
    word_type = batch.column("places").type.value_type
    row = pa.array(of)
    up = np.where(ok, node[np.maximum(parent, 0)], 0) if count else node
    columns = {
        "doc": batch.column("doc").take(row), "sent": batch.column("sent").take(row), "node": whole(node), "parent": whole(up, mask=~ok), "label": label, "depth": whole(level), "start": whole(start, word_type),
        "end": whole(end, word_type), "leaf": pa.array(leaf), "mirror": whole(mirror), "text": text, "head": heads,
    }
    return pa.RecordBatch.from_pydict(columns)
