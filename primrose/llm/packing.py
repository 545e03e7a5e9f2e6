"""Best-fit packing by bin completion with branch and bound."""

from __future__ import annotations

import bisect
import json
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator, AccumulatorParam
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from primrose.llm.common import kept_table
from primrose.session import ship_package

CAPACITY = 2048
GROUP_PIECES = 8192
SEARCH_NODES = 2000
SEARCH_DIVES = 3
WORST_BINS = (16, 64, 256)
CHOICES = 6
_PIECES = pa.schema(
    [
        ("doc", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
)
# Fixed value: how byte-level vocabularies cut a text before merging.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The pattern of the fast library backtracks over white space and gives up.
_LONG_BLANK = re.compile(r"\s{2000}")
_LATIN = re.compile("[\x00-\u024f\u2010-\u2027\u20ac]*\\Z")



def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the
    others, in order, as the letters from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TokenIds:
    """Token ids of a text, as the tokenizer of a file gives them, as
    little-endian 32-bit integers.

    For a byte-level vocabulary texts of Latin letters are encoded by tiktoken,
    built from the same file, which gives the same ids about four times as
    fast. All other texts, texts that hold a special token, and other kinds of
    files go through the tokenizer itself; so does the first text of each
    batch, and if the two should differ there, the whole batch.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        step, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = (
            step.get("type") == "ByteLevel"
            and not step.get("add_prefix_space")
            and step.get("use_regex", True)
            and spec.get("normalizer") is None
            and model.get("type", "BPE") == "BPE"
        )
        self.fast = self._same_by_tiktoken(model["vocab"]) if plain else None

    def _same_by_tiktoken(self, vocab: dict[str, int]):
        import tiktoken

        byte_of = _byte_of_letter()
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in vocab.items() if t not in self.special}
        return tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _slow(self, texts: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(c.ids, "<u4").tobytes() for c in coded]

    def _plain(self, text: str) -> bool:
        return bool(_LATIN.match(text)) and not _LONG_BLANK.search(text) and not any(s in text for s in self.special)

    def _quick(self, text: str) -> bytes | None:
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        except ValueError:  # its pattern gave up
            return None

    def of(self, texts: list[str]) -> list[bytes]:
        if self.fast is None or not texts:
            return self._slow(texts)
        plain = [self._plain(t) for t in texts]
        out = [self._quick(t) if ok else None for t, ok in zip(texts, plain, strict=True)]
        if out[0] is not None and out[0] != self._slow(texts[:1])[0]:
            out = [None] * len(texts)
        slow = [i for i, coded in enumerate(out) if coded is None]
        for i, coded in zip(slow, self._slow([texts[i] for i in slow]), strict=True):
            out[i] = coded
        return out


def _token_ids(path: str) -> TokenIds:
    """One for each worker process, so that tasks share what was built."""
    held = sys.modules[__name__].__dict__.setdefault("_HELD", {})
    if path not in held:
        held[path] = TokenIds(path)
    return held[path]


def cut_lengths(total: int, capacity: int) -> list[int]:
    """The first piece may be shorter; all others are full."""
    first = total % capacity
    return ([first] if first else []) + [capacity] * (total // capacity)


def _tokenise(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _token_ids(path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: dict[str, list] = {f.name: [] for f in _PIECES}
            for start in range(0, len(texts), 1024):
                for doc, coded in zip(
                    ids[start : start + 1024],
                    ids_of.of([t or "" for t in texts[start : start + 1024]]),
                    strict=True,
                ):
                    coded += end
                    at = 0
                    for piece, length in enumerate(cut_lengths(len(coded) // 4, capacity)):
                        rows["doc"].append(doc)
                        rows["piece"].append(piece)
                        rows["start"].append(at)
                        rows["length"].append(length)
                        rows["ids_crc32"].append(zlib.crc32(coded[4 * at : 4 * (at + length)]))
                        at += length
            yield pa.RecordBatch.from_pydict(rows, _PIECES)

    return pieces


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing: indexes of ``sizes`` by bin."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    used: list[int] = []  # residuals that some bin has, ascending
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect.bisect_left(used, sizes[i])
        if at == len(used):
            bins.append([i])
            b, left = len(bins) - 1, capacity - sizes[i]
        else:
            residual = used[at]
            b = free[residual].pop()
            if not free[residual]:
                used.pop(at)
            bins[b].append(i)
            left = residual - sizes[i]
        if left:
            if not free[left]:
                bisect.insort(used, left)
            free[left].append(b)
    return bins


def completions(sizes: list[int], counts: dict[int, int], room: int, choices: int) -> list[tuple[int, ...]]:
    """Fillings of ``room`` from the sizes left (``sizes`` descending), fullest
    first. A filling to which a size left over could be added, or in which one
    could take the place of an equal or smaller one, is dominated and left out.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    taken: dict[int, int] = {}
    below = [-s for s in sizes]

    def first(start: int, end: int) -> int:
        """The first size of a range of which one is left."""
        while start < end and counts[sizes[start]] <= taken.get(sizes[start], 0):
            start += 1
        return start

    def fitting(start: int, slack: int) -> int:
        return first(max(start, bisect.bisect_left(below, -slack)), len(sizes))

    def undominated(chosen: list[int], slack: int) -> bool:
        if not slack:
            return True
        if fitting(0, slack) < len(sizes):
            return False
        for c in set(chosen):
            end = bisect.bisect_left(below, -sizes[c])
            if first(bisect.bisect_left(below, -sizes[c] - slack), end) < end:
                return False
        return True

    chosen: list[int] = []  # places in sizes
    slack, k, tries = room, fitting(0, room), 0
    if k == len(sizes):
        return [()]
    # No recursion: a bin may hold as many pieces as it has tokens.
    while True:
        if k < len(sizes):
            chosen.append(k)
            taken[sizes[k]] = taken.get(sizes[k], 0) + 1
            slack -= sizes[k]
            k = fitting(k, slack)
            if k == len(sizes) and undominated(chosen, slack):
                bisect.insort(found, (slack, tuple(sizes[c] for c in chosen)))
            continue
        tries += 1
        enough = len(found) >= choices and found[choices - 1][0] == 0
        if not chosen or enough or (found and tries > 50 * choices):
            break
        last = chosen.pop()
        taken[sizes[last]] -= 1
        slack += sizes[last]
        k = fitting(last + 1, slack)
    return [c for _, c in found[:choices]]


def bin_completion(
    sizes: list[int],
    capacity: int = CAPACITY,
    nodes: int = SEARCH_NODES,
    choices: int = CHOICES,
    told: dict[str, int] | None = None,
) -> list[list[int]]:
    """Indexes of ``sizes`` (each at most ``capacity``) by bin.

    Full pieces are bins of their own. Best fit decreasing of the others is the
    first incumbent. While it needs more bins than the total size asks for, a
    depth-first search fills the bin of the largest size left with each
    undominated completion; a branch ends when its waste leaves no room to beat
    the incumbent. The search stops at the lower bound or after ``nodes`` bins
    tried, or ``SEARCH_DIVES`` times the lower bound if that is more, so that
    it can reach the last bin however many there are. Then the pieces of the
    worst filled bins alone (``WORST_BINS``) are searched in the same way; what
    they save is kept, and the incumbent stands.

    ``told`` gets ``bins``, ``least`` (lower bound), ``searched`` (1 unless best
    fit meets the bound), ``leaves`` (packings in fewer bins that the searches
    reached) and ``cut`` (searches ended by their number of nodes).
    """
    full = [[i] for i, s in enumerate(sizes) if s == capacity]
    rest = [i for i, s in enumerate(sizes) if s < capacity]
    told = {} if told is None else told
    told |= {"searched": 0, "leaves": 0, "cut": 0}

    def search(some: list[int]) -> list[list[int]]:
        found = _search([sizes[i] for i in some], capacity, nodes, choices, told)
        return [[some[i] for i in b] for b in found]

    best = search(rest)
    least = -(-sum(sizes[i] for i in rest) // capacity)
    for many in WORST_BINS:
        better = True
        while better and len(best) > max(least, 1):
            best.sort(key=lambda b: sum(sizes[i] for i in b))
            worst = sorted(i for b in best[:many] for i in b)
            again = search(worst)
            better = len(again) < min(many, len(best))
            if better:
                best = again + best[many:]
    told |= {"bins": len(full) + len(best), "least": len(full) + least}
    return full + best


def _search(sizes: list[int], capacity: int, nodes: int, choices: int, told: dict[str, int]) -> list[list[int]]:
    """One search of :func:`bin_completion`, from best fit on."""
    best = best_fit(sizes, capacity)
    total = sum(sizes)
    least = -(-total // capacity)
    if len(best) <= least:
        return best
    told["searched"] = 1
    counts: dict[int, int] = {}
    for s in sizes:
        counts[s] = counts.get(s, 0) + 1
    order = sorted(counts, reverse=True)
    budget = max(nodes, SEARCH_DIVES * least)
    # Each level: completions still to try for its bin, and the one in use.
    levels: list[tuple[int, list[tuple[int, ...]]]] = []
    used: list[tuple[int, ...]] = []
    waste = 0

    def allowed() -> int:
        return capacity * (len(best) - 1) - total

    def open_level() -> None:
        largest = next(s for s in order if counts[s])
        counts[largest] -= 1
        left = [s for s in order if counts[s] and s <= capacity - largest]
        levels.append((largest, completions(left, counts, capacity - largest, choices)[::-1]))

    open_level()
    while levels and budget > 0:
        largest, todo = levels[-1]
        if len(used) == len(levels):  # take back the completion in use
            for s in used[-1]:
                counts[s] += 1
            waste -= capacity - largest - sum(used[-1])
            used.pop()
        if not todo:
            levels.pop()
            counts[largest] += 1
            continue
        budget -= 1
        filling = todo.pop()
        gap = capacity - largest - sum(filling)
        used.append(filling)
        waste += gap
        for s in filling:
            counts[s] -= 1
        if waste > allowed():
            continue
        if any(counts[s] for s in order):
            open_level()
            continue
        packed = [(levels[i][0], *used[i]) for i in range(len(used))]
        if len(packed) < len(best):
            told["leaves"] += 1
            where: dict[int, list[int]] = {}
            for i, s in enumerate(sizes):
                where.setdefault(s, []).append(i)
            best = [[where[s].pop() for s in b] for b in packed]
        if len(best) <= least:
            break
    told["cut"] += budget <= 0 and len(best) > least
    return best


class Tally(AccumulatorParam):
    """Sums by name: what the packing of each group told."""

    def zero(self, value: dict[str, int]) -> dict[str, int]:
        return {}

    def addInPlace(self, value1: dict[str, int], value2: dict[str, int]) -> dict[str, int]:
        return {k: value1.get(k, 0) + value2.get(k, 0) for k in {*value1, *value2}}


def _pack(capacity: int, tally: Accumulator | None):
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc", "ascending"), ("piece", "ascending")])
        lengths = table.column("length").to_pylist()
        group = table.column("group")[0].as_py()
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        told: dict[str, int] = {}
        bins = bin_completion(lengths, capacity, told=told)
        if tally is not None:
            tally.add({"groups": 1, "reached": int(told["leaves"] > 0), **told})
        for number, members in enumerate(bins):
            at = 0
            for i in members:
                sequence[i], offset[i] = (group << 32) + number, at
                at += lengths[i]
        return table.drop(["group"]).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column(
            "offset", pa.array(offset, pa.int64())
        )

    return pack


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 0,
    group_pieces: int = GROUP_PIECES,
    tally: Accumulator | None = None,
) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most
    ``capacity`` tokens: id, ``piece, start, length, ids_crc32, sequence_id,
    offset``.

    Tokenising leaves one narrow row per piece; texts do not move. Pieces are
    dealt by hash into groups of about ``group_pieces``, each packed in one
    task; a group leaves one sequence at most partly filled when best fit or
    the search meets the bound. Documents that are full pieces by chance are
    sequences of their own like any.

    Null and empty texts are a piece of one end token. Null ids and repeated
    rows are packed as rows of their own. An empty table gives an empty result.
    The tokenizer file must lie at ``tokenizer_path`` on every executor.
    ``tally`` (an accumulator of :class:`Tally`) gets, once the result is made,
    ``groups``, how many of them ``reached`` a better packing than best fit, and
    the sums of what :func:`bin_completion` told.
    """
    ship_package(docs.sparkSession)
    names = "doc long, piece int, start long, length long, ids_crc32 long"
    pieces = kept_table(
        docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(
            _tokenise(tokenizer_path, capacity, end_id), names
        ),
        "pieces",
    )
    groups = max(1, -(-pieces.count() // group_pieces))
    # Repeated rows of a document go to different groups or to one; either is
    # right, and neither makes a group large unless one row repeats that often.
    dealt = pieces.withColumn(
        "group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(1)), F.lit(groups))
    )
    packed = dealt.groupBy("group").applyInArrow(_pack(capacity, tally), names + ", sequence_id long, offset long")
    return packed.withColumnRenamed("doc", id_col)
