"""Token counts by a compiled finite-state tokenizer.

Word splitting and byte-pair merging of a tokenizer file become one
deterministic transducer over bytes. Its transitions carry the number of tokens
they emit, so that counting is a walk through two tables. Texts are cut into
chunks that are walked side by side; what a chunk does is a map from the state
before it to the state after it and a count, and the maps of the chunks of a
text are composed by a parallel prefix scan.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from primrose.session import ship_package

LIMIT = 2048
GROUP = 4_000_000  # symbols walked together
SLICE = 1_000_000  # characters of one text taken at a time
LOOK = 64  # steps after which two walks of a chunk are compared
MANY = 64  # tokens of one beginning that are looked through
MAX_STATES = 250_000  # states kept before the tables are cut back

# The word pattern this transducer is compiled for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"

# Symbols: a byte and the kind of character it belongs to.
LETTER, OTHER, DIGIT, DIGIT_MORE = 0, 256, 512, 768
SPACE, SPECIAL = 1024, 1025
# Where a walk stands between two bytes.
BORDER, IN_LETTERS, IN_OTHER, IN_DIGIT, QUOTE = range(5)
_SHORT = frozenset(b"stmd")  # one letter after a quote makes a word
_LONG = {ord("r"): ord("e"), ord("v"): ord("e"), ord("l"): ord("l")}  # these two do
_NEVER = 1 << 60


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte, as byte-level vocabularies have it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Merges:
    """Byte-pair merging as an automaton over the symbols of one word.

    Symbols are characters: chr(byte), and chr(256 + byte) for the last byte of
    a word. Merging has the prefix property: the last token after each byte is
    the one suffix that is a token and may stand behind the last token before
    it. So a state holds the longest suffix that can still grow into a token
    and, for each position in it, the last token and the tokens counted so far.
    """

    def __init__(self, model: dict):
        letters = _byte_letters()
        name = {}
        for stand_in, byte in letters.items():
            name[stand_in], name[stand_in + END] = chr(byte), chr(256 + byte)
        self.rank: dict[tuple[str, str], int] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        for order, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            joined = name[a] + name[b]
            if joined in self.parts:
                raise ValueError("two merges make the same token")
            name[a + b] = joined
            self.rank[name[a], name[b]] = order
            self.parts[joined] = (name[a], name[b])
        self.tokens = set(name.values())
        self.prefixes = {t[:i] for t in self.tokens for i in range(len(t))}
        # Tokens by their beginnings, where these are at most MANY.
        tokens_of: dict[str, list[str]] = {}
        for t in self.tokens:
            for i in range(1, len(t)):
                tokens_of.setdefault(t[:i], []).append(t)
        self.completions = {p: ts for p, ts in tokens_of.items() if len(ts) <= MANY}
        self._pairs: dict[tuple[str, str], bool] = {}
        self._starts: dict[tuple[str, str], bool] = {}
        self.forget()

    def forget(self) -> None:
        """Back to the first state; what is known of tokens stays, up to a bound."""
        self.states: list[tuple[str, tuple, tuple]] = []
        self._ids: dict[tuple[str, tuple, tuple], int] = {}
        self._steps: dict[tuple[int, int], tuple[int, int]] = {}
        self._ends: dict[tuple[int, int], int] = {}
        self.number("", (None,), (0,))
        if len(self._pairs) + len(self._starts) > 8 * MAX_STATES:
            self._pairs.clear()
            self._starts.clear()

    def number(self, suffix: str, lasts: tuple, counts: tuple) -> int:
        """The number of a state, a new one at need."""
        key = (suffix, lasts, counts)
        if key not in self._ids:
            self._ids[key] = len(self.states)
            self.states.append(key)
        return self._ids[key]

    def _spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """The tokens at one edge of ``token`` while it is merged, each with
        the rank of the merge that ends it; from a single symbol upwards."""
        out, until = [], _NEVER
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out[::-1]
            until = self.rank[self.parts[token]]
            token = self.parts[token][side]

    def _stay_apart(self, a: str, b: str) -> bool:
        """Whether no merge crosses the border when ``a`` and ``b`` meet."""
        known = self._pairs.get((a, b))
        if known is None:
            left, right = self._spine(a, 1), self._spine(b, 0)
            i = j = 0
            known = True
            while known:
                (x, x_until), (y, y_until) = left[i], right[j]
                across = self.rank.get((x, y), _NEVER)
                # Of equal ranks the left one goes first.
                if across < x_until and across <= y_until:
                    known = False
                elif x_until == y_until == _NEVER:
                    break
                elif x_until <= y_until:
                    i += 1
                else:
                    j += 1
            self._pairs[a, b] = known
        return known

    def _may_start(self, last: str | None, start: str) -> bool:
        """Whether some token that begins with ``start`` may stand behind
        ``last``. "" means that none may; for a start with many tokens the
        answer is yes without a look, which costs states, not results."""
        if last is None or not start:
            return True
        if not last:
            return False
        known = self._starts.get((last, start))
        if known is None:
            tokens = self.completions.get(start)
            known = tokens is None or any(self._stay_apart(last, t) for t in tokens)
            self._starts[last, start] = known
        return known

    def _last(self, state: int, symbol: str) -> tuple[str, str, int]:
        """Grown suffix, its last token, and the tokens counted up to it."""
        suffix, lasts, counts = self.states[state]
        grown = suffix + symbol
        for k in range(len(grown)):
            token = grown[k:]
            if token in self.tokens and lasts[k] != "" and (lasts[k] is None or self._stay_apart(lasts[k], token)):
                return grown, token, counts[k] + 1
        raise ValueError("symbol outside the vocabulary")

    def feed(self, state: int, byte: int) -> tuple[int, int]:
        """State behind a byte inside a word, and the tokens now certain."""
        found = self._steps.get((state, byte))
        if found is None:
            _, lasts, counts = self.states[state]
            grown, token, count = self._last(state, chr(byte))
            k = next(k for k in range(len(grown) + 1) if grown[k:] in self.prefixes)
            # Only positions that a token may still start from are told apart.
            lasts, counts = (*lasts, token), (*counts, count)
            useful = [grown[p:] in self.prefixes and self._may_start(lasts[p], grown[p:]) for p in range(k, len(lasts))]
            k += useful.index(True)
            useful = useful[-(len(lasts) - k) :]
            least = min(c for c, u in zip(counts[k:], useful, strict=True) if u)
            after = self.number(
                grown[k:],
                tuple(t if u else "" for t, u in zip(lasts[k:], useful, strict=True)),
                tuple(c - least if u else 0 for c, u in zip(counts[k:], useful, strict=True)),
            )
            found = self._steps[state, byte] = (after, least)
        return found

    def finish(self, state: int, byte: int) -> int:
        """Tokens emitted when ``byte`` ends the word."""
        found = self._ends.get((state, byte))
        if found is None:
            found = self._ends[state, byte] = self._last(state, chr(256 + byte))[2]
        return found


class Transducer:
    """The whole tokenizer: states ``(mode, waiting byte, merge state)``, built
    when a walk first needs them. The byte last read waits, because only the
    next one tells whether it ended its word."""

    def __init__(self, model: dict):
        self.merges = Merges(model)
        self.columns = np.full(1026, -1, np.int32)
        self.symbols: list[int] = []
        self._clear(1024, 64)

    def _clear(self, rows: int, width: int) -> None:
        self.merges.forget()
        self.keys: list[tuple[int, int, int]] = []
        self.ids: dict[tuple[int, int, int], int] = {}
        self.next = np.full((rows, width), -1, np.int32)
        self.emit = np.zeros((rows, width), np.int16)
        self._number((BORDER, 0, 0))

    def _number(self, key: tuple[int, int, int]) -> int:
        if key not in self.ids:
            self.ids[key] = len(self.keys)
            self.keys.append(key)
            if len(self.keys) > len(self.next):
                self._widen(len(self.next), 0)
        return self.ids[key]

    def _widen(self, rows: int, width: int) -> None:
        self.next = np.pad(self.next, ((0, rows), (0, width)), constant_values=-1)
        self.emit = np.pad(self.emit, ((0, rows), (0, width)))

    def _begin(self, symbol: int) -> tuple[tuple[int, int, int], int]:
        kind, byte = symbol & ~255, symbol & 255
        if symbol == SPACE:
            return (BORDER, 0, 0), 0
        if symbol == SPECIAL:
            return (BORDER, 0, 0), 1
        if kind == LETTER:
            return (IN_LETTERS, byte, 0), 0
        if kind == OTHER:
            return ((QUOTE, 0, 0) if byte == 39 else (IN_OTHER, byte, 0)), 0
        return (IN_DIGIT, byte, 0), 0

    def _word(self, word: bytes) -> int:
        state = total = 0
        for byte in word[:-1]:
            state, n = self.merges.feed(state, byte)
            total += n
        return total + self.merges.finish(state, word[-1])

    def step(self, key: tuple[int, int, int], symbol: int) -> tuple[tuple[int, int, int], int]:
        mode, waits, state = key
        kind, byte = symbol & ~255, symbol & 255
        if mode == BORDER:
            return self._begin(symbol)
        if mode == QUOTE and not waits:
            if kind == LETTER and byte in _SHORT:
                return (BORDER, 0, 0), self._word(bytes([39, byte]))
            if kind == LETTER and byte in _LONG:
                return (QUOTE, byte, 0), 0
            if kind == OTHER:
                after, n = self.merges.feed(0, 39)
                return (IN_OTHER, byte, after), n
            key, n = self._begin(symbol)
            return key, n + self._word(b"'")
        if mode == QUOTE:
            if kind == LETTER and byte == _LONG[waits]:
                return (BORDER, 0, 0), self._word(bytes([39, waits, byte]))
            key, n = self.step((IN_LETTERS, waits, 0), symbol)
            return key, n + self._word(b"'")
        goes_on = {IN_LETTERS: LETTER, IN_OTHER: OTHER, IN_DIGIT: DIGIT_MORE}[mode]
        if kind == goes_on:
            after, n = self.merges.feed(state, waits)
            return (mode, byte, after), n
        key, n = self._begin(symbol)
        return key, n + self.merges.finish(state, waits)

    def to_columns(self, symbols: np.ndarray) -> np.ndarray:
        """Table columns of symbols; a symbol gets one when it first occurs."""
        for s in np.flatnonzero(np.bincount(symbols, minlength=1026)):
            if self.columns[s] < 0:
                self.columns[s] = len(self.symbols)
                self.symbols.append(int(s))
        missing = len(self.symbols) - self.next.shape[1]
        if missing > 0:
            self._widen(0, missing + 16)
        return self.columns[symbols]

    def _build(self, state: int, column: int) -> None:
        key, n = self.step(self.keys[state], self.symbols[column])
        after = self._number(key)
        self.next[state, column], self.emit[state, column] = after, n

    def _cut_back(self, held: list[np.ndarray]) -> None:
        """Forgets all states but those in ``held``, which are renumbered."""
        kept = np.unique(np.concatenate(held))
        old = [(self.keys[i], self.merges.states[self.keys[i][2]]) for i in kept]
        self._clear(max(1024, 2 * len(kept)), self.next.shape[1])
        renamed = np.array([self._number((m, w, self.merges.number(*s))) for (m, w, _), s in old], np.int32)
        for a in held:
            a[:] = renamed[np.searchsorted(kept, a)]

    def walk(
        self, columns: np.ndarray, at: np.ndarray, steps: np.ndarray, state: np.ndarray, held: list[np.ndarray]
    ) -> np.ndarray:
        """Walks all lanes side by side; ``state`` is moved in place and the
        emitted counts are returned. ``held``: other arrays of states in use."""
        order = np.argsort(-steps, kind="stable")
        ends = np.sort(steps)
        here, now, count = at[order], state[order], np.zeros(len(at), np.int64)
        cap = MAX_STATES
        for t in range(int(ends[-1]) if len(ends) else 0):
            m = len(ends) - int(np.searchsorted(ends, t, "right"))
            column = columns[here[:m] + t]
            wide = self.next.shape[1]
            place = now[:m].astype(np.int64) * wide + column
            after = self.next.ravel()[place]
            if after.min() < 0:
                for p in np.unique(place[after < 0]).tolist():
                    self._build(p // wide, p % wide)
                after = self.next.ravel()[place]
            count[:m] += self.emit.ravel()[place]
            now[:m] = after
            if len(self.keys) > cap:
                self._cut_back([now, state, *held])
                cap = max(MAX_STATES, 2 * len(self.keys))
        state[order] = now
        out = np.empty_like(count)
        out[order] = count
        return out

    def count(self, texts: list[np.ndarray], entry: np.ndarray) -> np.ndarray:
        """Tokens of each array of symbols. The first starts in state
        ``entry[0]``, which becomes the state behind the last; the others start
        at a word border."""
        lengths = np.array([len(t) for t in texts], np.int64)
        columns = self.to_columns(np.concatenate(texts)) if lengths.sum() else np.zeros(0, np.int32)
        size = int(min(4096, max(256, lengths.sum() // 1024)))
        pieces = np.maximum(1, -(-lengths // size))
        first = np.cumsum(pieces) - pieces
        text = np.repeat(np.arange(len(texts)), pieces)
        part = np.arange(len(text)) - first[text]
        at = (np.cumsum(lengths) - lengths)[text] + part * size
        steps = np.minimum(size, lengths[text] - part * size)
        more = part + 1 < pieces[text]

        # The map of each chunk where it starts at a word border.
        lanes = len(text)
        begin = np.zeros(lanes, np.int32)
        begin[0] = entry[0]
        state = begin.copy()
        look = np.minimum(steps, LOOK)
        early = self.walk(columns, at, look, state, [begin, entry])
        seen = state.copy()
        late = self.walk(columns, at + look, steps - look, state, [begin, entry, seen])
        chunk, counts = np.arange(lanes), early + late
        # Other states may come before a chunk: its map grows by these until
        # the chunk before leads to no new one. Most walks meet the first walk
        # of their chunk after a few bytes, and end there.
        follows = np.full(lanes, -1, np.int64)
        known = [[i] for i in range(lanes)]
        fresh = np.flatnonzero(more)
        while len(fresh):
            want_chunk, want_state = [], []
            new_of: dict[tuple[int, int], int] = {}
            for node in fresh.tolist():
                nxt, needed = int(chunk[node]) + 1, int(state[node])
                hit = next((k for k in known[nxt] if begin[k] == needed), None)
                if hit is None:
                    hit = new_of.get((nxt, needed))
                if hit is None:
                    hit = new_of[nxt, needed] = len(chunk) + len(want_chunk)
                    want_chunk.append(nxt)
                    want_state.append(needed)
                follows[node] = hit
            if not want_chunk:
                break
            c = np.array(want_chunk)
            b = np.array(want_state, np.int32)
            s = b.copy()
            held = [begin, entry, seen, state]
            n = self.walk(columns, at[c], look[c], s, [*held, b])
            apart = np.flatnonzero(s != seen[c])
            rest = s[apart]
            n_rest = self.walk(columns, at[c[apart]] + look[c[apart]], (steps - look)[c[apart]], rest, [*held, b, s])
            n = n + late[c]
            n[apart] += n_rest - late[c[apart]]
            s = state[c]
            s[apart] = rest
            fresh = len(chunk) + np.flatnonzero(more[c])
            for i, k in enumerate(want_chunk):
                known[k].append(len(chunk) + i)
            chunk, begin, state = np.concatenate([chunk, c]), np.concatenate([begin, b]), np.concatenate([state, s])
            counts, follows = np.concatenate([counts, n]), np.concatenate([follows, np.full(len(c), -1)])

        # Prefix scan: each round composes twice as many maps.
        last = len(chunk)
        jump = np.append(np.where(follows < 0, last, follows), last)
        total = np.append(counts, 0)
        final = np.append(state, 0)
        while (jump < last).any():
            ahead = jump < last
            final = np.where(ahead, final[jump], final)
            total = total + total[jump]
            jump = jump[jump]
        if len(texts):
            entry[0] = final[first[-1]]
        return total[first]


class Symbols:
    """Texts as arrays of symbols, by the tokenizer's own normaliser and, for
    each new character, its own splitter."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        spec = json.loads(source)
        splitters = spec["pre_tokenizer"].get("pretokenizers", [{}])
        model = spec["model"]
        if (
            model["type"] != "BPE"
            or model["end_of_word_suffix"] != END
            or model["continuing_subword_prefix"]
            or splitters[0].get("pattern", {}).get("Regex") != PATTERN
        ):
            raise ValueError("not a tokenizer of lower-case words with word ends")
        whole = Tokenizer.from_str(source)
        self._normal, self._split = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        special = [t["content"] for t in spec["added_tokens"]]
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with conditions are not supported")
        special.sort(key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self._kinds = np.full(0x110000, 255, np.uint8)
        self._ascii = np.zeros(128, np.int16)
        for code in range(128):
            normal = self._normal(chr(code))
            self._ascii[code] = self._wide(normal)[0]

    def _kind(self, character: str) -> int:
        if not self._split(character):
            return 3
        if len(self._split("a" + character)) == 1:
            return 0
        return 1 if len(self._split("!" + character)) == 1 else 2

    def _wide(self, normal: str) -> np.ndarray:
        codes = np.frombuffer(normal.encode("utf-32-le"), "<u4")
        for code in np.unique(codes[self._kinds[codes] == 255]).tolist():
            self._kinds[code] = self._kind(chr(code))
        widths = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        kinds = np.repeat(self._kinds[codes], widths)
        data = np.frombuffer(normal.encode(), np.uint8).astype(np.int16)
        out = data + np.array([LETTER, OTHER, DIGIT, 0], np.int16)[kinds]
        out[(kinds == 2) & ((data & 0xC0) == 0x80)] += DIGIT_MORE - DIGIT
        out[kinds == 3] = SPACE
        return out

    def _plain(self, text: str) -> np.ndarray:
        if text.isascii():
            return self._ascii[np.frombuffer(text.encode(), np.uint8)]
        return self._wide(self._normal(text))

    def slices(self, text: str) -> Iterator[np.ndarray]:
        """Symbols of a whole text, with a border at its end; long texts in
        slices. A slice ends behind a blank, where neither a composed character
        nor a special token can be cut."""
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > SLICE:
                blank = re.compile(r"[ \t\n]").search(text, at + SLICE)
                end = blank.end() if blank else end
            parts, done = [], at
            for hit in self._special.finditer(text, at, end):
                parts += [self._plain(text[done : hit.start()]), np.array([SPECIAL], np.int16)]
                done = hit.end()
            parts.append(self._plain(text[done:end]))
            if end == len(text):
                parts.append(np.array([SPACE], np.int16))
            yield np.concatenate(parts)
            at = end


_COMPILED: dict[int, tuple[Symbols, Transducer]] = {}


def compiled(source: str) -> tuple[Symbols, Transducer]:
    """Symbols and transducer of a tokenizer file, once per process."""
    key = hash(source)
    if key not in _COMPILED:
        _COMPILED[key] = (Symbols(source), Transducer(json.loads(source)["model"]))
    return _COMPILED[key]


def count_texts(texts: list[str | None], source: str) -> np.ndarray:
    """Tokens of each text; groups of about ``GROUP`` symbols are walked
    together, and a longer text goes on in the next group."""
    symbols, transducer = compiled(source)
    totals = np.zeros(len(texts), np.int64)
    entry = np.zeros(1, np.int32)
    group: list[np.ndarray] = []
    owners: list[int] = []
    held = 0

    def flush(open_text: bool) -> None:
        nonlocal held
        if group:
            np.add.at(totals, owners, transducer.count(group, entry))
            group.clear()
            owners.clear()
            held = 0
        if not open_text:
            entry[0] = 0

    for i, text in enumerate(texts):
        if not text:
            continue
        slices = symbols.slices(text)
        one = next(slices)
        for following in slices:
            # A long text: each slice goes alone into a group that stays open.
            group.append(one)
            owners.append(i)
            flush(True)
            one = following
        group.append(one)
        owners.append(i)
        held += len(one)
        if held >= GROUP or len(one) >= SLICE:
            flush(False)
    flush(False)
    return totals


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT
) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of every row, as the tokenizer
    file at ``path`` counts: no added begin or end; special strings inside a
    text count one token each; nothing is truncated.

    A null or empty text has 0 bytes and 0 tokens. Ids are carried as they
    are: null and repeated ids give one row each. A text of any length is read
    in slices of about ``SLICE`` characters (a text without a blank in one).
    An empty table gives an empty result; other columns are not read.
    """
    ship_package(docs.sparkSession)
    with open(path, encoding="utf-8") as file:
        source = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = count_texts(b.column("text").to_pylist(), source.value)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
