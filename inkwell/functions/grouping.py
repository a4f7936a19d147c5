"""Tokens of a batch of documents grouped by term, as array operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from inkwell.functions.stems import porter

def _sizes(lists: pa.Array) -> np.ndarray:
    """The size of every list; null counts as empty."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _ranks(order: np.ndarray) -> np.ndarray:
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.arange(len(order))
    return ranks


def _firsts(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Marks the first of every key, counting only the places `among`."""
    marks = np.zeros(len(keys), bool)
    marks[among[np.unique(keys[among], return_index=True)[1]]] = True
    return marks


def by_tokens(docs: pa.RecordBatch, names: list[str], tokens: int) -> Iterator[pa.RecordBatch]:
    """Slices of about so many tokens, one document at least."""
    block = np.cumsum(sum(_sizes(docs[f"{name}_terms"]) for name in names)) // tokens
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), docs.num_rows]
    for start, end in zip(cuts, cuts[1:]):
        yield docs.slice(start, end - start)


def group_tokens(docs: pa.RecordBatch, weights: dict[str, float], columns: tuple[str, ...]) -> pa.RecordBatch:
    """Postings of documents whose columns `<name>_terms` and `<name>_buckets` list the terms of the indexed column
    `name` and their buckets, ordered by bucket, term, id and column.

    The tokens come by column and place, so a stable sort by (term, document) leaves each posting as a run of equal
    (term, document, column) with ascending places. A document is whole in its block, so one posting of every stem that
    it holds is marked here, and one of every stem of its title.
    """
    names = list(weights)
    lists = [docs[f"{name}_terms"] for name in names]
    sizes = [_sizes(x) for x in lists]
    words = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
    word = words.indices.to_numpy(zero_copy_only=False)
    owner = np.concatenate([np.repeat(np.arange(docs.num_rows), n) for n in sizes])
    place = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in sizes])
    code = np.repeat(np.arange(len(names)), [n.sum() for n in sizes])
    bucket = np.zeros(len(words.dictionary), np.int64)
    bucket[word] = np.concatenate([docs[f"{name}_buckets"].flatten().to_numpy(zero_copy_only=False) for name in names])
    by_word = pc.sort_indices(words.dictionary).to_numpy()
    rank = _ranks(by_word[np.argsort(bucket[by_word], kind="stable")])
    by_id = _ranks(pc.sort_indices(docs["id"]).to_numpy())
    key = rank[word] * docs.num_rows + by_id[owner]
    order = np.argsort(key, kind="stable")
    key, code = key[order], code[order]
    new_key = np.append(True, key[1:] != key[:-1])[: len(key)]
    starts = np.flatnonzero(new_key | np.append(True, code[1:] != code[:-1])[: len(key)])
    ends = np.append(starts, len(key)).astype(np.int32)
    first, of_doc = order[starts], pa.array(owner[order[starts]])
    stems = pa.array(map(porter, words.dictionary.to_pylist()), pa.string()).dictionary_encode()
    stem_of = stems.indices.to_numpy(zero_copy_only=False).astype(np.int64)[word[first]]
    stem_key = stem_of * docs.num_rows + owner[first]
    found = {
        "term": words.dictionary.take(pa.array(word[first])),
        "col": pa.array(names, pa.string()).take(pa.array(code[starts])),
        "weight": pa.array(np.array(list(weights.values()))[code[starts]], pa.float64()),
        "lead": pa.array(new_key[starts]),
        "n_places": pa.array(np.diff(ends), pa.int32()),
        "positions": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[order], pa.int32())),
        "n_tokens": pa.array(sum(sizes), pa.int64()).take(of_doc),
        "stem": stems.dictionary.take(pa.array(stem_of)),
        "stem_lead": pa.array(_firsts(stem_key, np.arange(len(starts)))),
        "title_lead": pa.array(_firsts(stem_key, np.flatnonzero(code[starts] == names.index("title")))),
    }
    return pa.RecordBatch.from_arrays([found[c] if c in found else docs[c].take(of_doc) for c in columns], list(columns))
