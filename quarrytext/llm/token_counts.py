"""Exact token counts by compiled finite-state transducers (operator 5).

Two deterministic machines are compiled from a byte-level BPE tokenizer file:

* a pre-tokenizer over symbols (a character's class with one character of look-ahead) that marks
  where pieces start.  A stream of many texts is cut into chunks; for every chunk the map from each
  start state to its end state is computed, the maps compose through a parallel prefix scan, and a
  second pass with the then known start states marks the pieces;
* a merge transducer over bytes whose transitions carry the change in the number of tokens emitted so
  far (a longer prefix can need fewer tokens, so a change may be negative).  Its states are
  determinised when first met, within a bounded cache: what they keep of the read prefix is, for
  each open token start, the last token before it and the tokens emitted there.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrytext.llm.base import only, schema_of

STREAM = 1 << 20  # characters handled at once; a longer text is a stream of its own
WIDTH = 256  # characters in a chunk
MAX_STATES = 150_000  # of the merge transducer; the cache starts anew beyond that
MAX_PIECES = 400_000  # pieces whose count is remembered; likewise
MAX_BORDERS = 400_000  # pairs of tokens of which it is remembered whether they stand; likewise

# Symbols of the pre-tokenizer.  END: between texts; SPACE: a blank before a visible character;
# LAST: other white space before one; WHITE: white space before white space or the end; QUOTE: an
# apostrophe; SHORT: s t m d; OPEN: r or v before e, l before l.
END, LETTER, NUMBER, OTHER, QUOTE, SHORT, OPEN, SPACE, LAST, WHITE = range(10)
N_SYMBOLS = 10
# States: nothing open; in letters, numbers, others, white space; after a leading blank; after an
# apostrophe that starts a piece; after that and OPEN.
FREE, IN_L, IN_N, IN_O, IN_W, BLANK, QUOTED, OPENED = range(8)
N_STATES = 8


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """The next state and whether a piece starts, by state and symbol."""
    fresh = {END: FREE, LETTER: IN_L, SHORT: IN_L, OPEN: IN_L, NUMBER: IN_N, OTHER: IN_O, QUOTE: QUOTED, SPACE: BLANK, LAST: FREE, WHITE: IN_W}
    letters, others = (LETTER, SHORT, OPEN), (OTHER, QUOTE)
    follow = {
        IN_L: dict.fromkeys(letters, IN_L),
        IN_N: {NUMBER: IN_N},
        IN_O: dict.fromkeys(others, IN_O),
        IN_W: {WHITE: IN_W},
        BLANK: dict.fromkeys(letters, IN_L) | {NUMBER: IN_N} | dict.fromkeys(others, IN_O),
        QUOTED: {SHORT: FREE, OPEN: OPENED} | dict.fromkeys(others, IN_O),
        OPENED: dict.fromkeys(letters, FREE),
    }
    to, starts = np.zeros((N_STATES, N_SYMBOLS), np.uint8), np.ones((N_STATES, N_SYMBOLS), bool)
    for state in range(N_STATES):
        for symbol, target in fresh.items():
            to[state, symbol] = target
        for symbol, target in follow.get(state, {}).items():
            to[state, symbol], starts[state, symbol] = target, False
    return to, starts


TO, STARTS = _machine()
#: The maps of two symbols in a row, as [first * N_SYMBOLS + second, state].
TO_PAIR = np.array([[TO[TO[s, a], b] for s in range(N_STATES)] for a in range(N_SYMBOLS) for b in range(N_SYMBOLS)], np.uint8)


def scan_maps(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps: row i becomes map 0, then 1, ... then i."""
    maps, reach = maps.copy(), 1
    while reach < len(maps):
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), axis=1)
        reach *= 2
    return maps


def piece_starts(symbols: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Where pieces start in a stream of symbols."""
    n = len(symbols)
    width += width % 2
    lanes = max(1, -(-n // width))
    grid = np.zeros(lanes * width, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(lanes, width).T)  # step by lane
    pairs = grid[0::2].astype(np.int32) * N_SYMBOLS + grid[1::2]
    maps = np.tile(np.arange(N_STATES, dtype=np.int32), (lanes, 1))
    flat = TO_PAIR.ravel().astype(np.int32)
    for step in pairs:
        maps = flat.take(maps + (step * N_STATES)[:, None])
    state = np.concatenate(([FREE], scan_maps(maps)[:-1, FREE])).astype(np.int32)
    to, starts = TO.ravel().astype(np.int32), STARTS.ravel()
    marks = np.empty(grid.shape, bool)
    for k, step in enumerate(grid):
        at = state * N_SYMBOLS + step
        marks[k] = starts.take(at)
        state = to.take(at)
    return np.flatnonzero(marks.T.ravel()[:n])


class _State:
    __slots__ = ("open", "to")

    def __init__(self, held):
        self.open, self.to = held, {}


class Tokenizer:
    """The transducers of one byte-level BPE tokenizer file in the JSON form of the ``tokenizers`` library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            raw = file.read()
        spec = json.loads(raw)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"] or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError(f"{path}: only plain byte-level BPE can be compiled")
        added = spec.get("added_tokens", [])
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in added):
            raise ValueError(f"{path}: added tokens with strip or single-word rules")
        names = sorted((x["content"] for x in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        from tokenizers import Tokenizer as Library

        self._probe = Library.from_str(raw).pre_tokenizer.pre_tokenize_str
        self._classes = np.full(0x110001, 255, np.uint8)
        self._classes[0x110000] = END

        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        rest = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
        plain = lambda token: bytes(byte[c] for c in token)
        self._ids = {bytes([b]): b for b in range(256)}
        left, right, rank, self._pair = {}, {}, {b: -1 for b in range(256)}, {}
        for k, merge in enumerate(model["merges"]):
            a, b = map(plain, merge if isinstance(merge, list) else merge.split(" "))
            x, y, made = self._ids[a], self._ids[b], 256 + k
            if a + b in self._ids:
                raise ValueError(f"{path}: two merges make the same token")
            self._ids[a + b], left[made], right[made], rank[made], self._pair[x, y] = made, x, y, k, k
        never = 1 << 40

        def spine(token: int, down: dict) -> list[tuple[int, int]]:
            """Tokens at the edge while ``token`` grows, each with the rank of the merge that ends it."""
            out, until = [], never
            while True:
                out.append((token, until))
                if token not in down:
                    return out
                until, token = rank[token], down[token]

        self._right = [spine(t, right) for t in range(len(self._ids))]
        self._left = [spine(t, left) for t in range(len(self._ids))]
        # A trie of all tokens: children by node and byte, the token that ends at a node, inner nodes.
        self._child: dict[int, int] = {}
        self._ends = [-1]
        for name, token in self._ids.items():
            node = 0
            for b in name:
                below = self._child.get(node << 8 | b)
                if below is None:
                    below = self._child[node << 8 | b] = len(self._ends)
                    self._ends.append(-1)
                node = below
            self._ends[node] = token
        self._inner = bytearray(len(self._ends))
        for key in self._child:
            self._inner[key >> 8] = 1
        del self._ids
        self._reset()
        self._pieces: dict[str, int] = {}
        self._borders: dict[int, bool] = {}

    def _reset(self) -> None:
        self._states: dict[tuple, _State] = {}
        self._root = self._state(((0, -1, 0),))

    def _state(self, held: tuple) -> _State:
        found = self._states.get(held)
        if found is None:
            found = self._states[held] = _State(held)
        return found

    def _stand(self, one: int, two: int) -> bool:
        """Whether two tokens side by side stay as they are: no merge over their border comes first."""
        known = self._borders.get(one << 32 | two)
        if known is None:
            if len(self._borders) >= MAX_BORDERS:
                self._borders.clear()
            known = self._borders[one << 32 | two] = self._merges_later(one, two)
        return known

    def _merges_later(self, one: int, two: int) -> bool:
        pair = self._pair
        for x, until_x in self._right[one]:
            for y, until_y in self._left[two]:
                k = pair.get((x, y))
                if k is not None and k < until_x and k <= until_y:
                    return False
        return True

    def _extend(self, state: _State, byte: int) -> tuple[_State, int]:
        """Determinise one transition: the next state and the change in emitted tokens."""
        child, last, change = self._child, None, 0
        longer = []
        for node, before, emitted in state.open:
            node = child.get(node << 8 | byte)
            if node is not None:
                token = self._ends[node]
                if last is None and token >= 0 and (before < 0 or self._stand(before, token)):
                    last, change = token, emitted + 1
                if self._inner[node]:
                    longer.append((node, before, emitted))
        held = (*[(n, b, e - change) for n, b, e in longer], (0, last, 0))
        found = state.to[byte] = (self._state(held), change)
        return found

    def count_piece(self, piece: bytes) -> int:
        """The tokens of one piece, by running the merge transducer over its bytes."""
        if len(self._states) > MAX_STATES:
            self._reset()
        state, total = self._root, 0
        for k, byte in enumerate(piece):
            found = state.to.get(byte)
            if found is None:
                if len(self._states) > 2 * MAX_STATES:  # within one very long piece: keep only where it stands
                    held = state.open
                    self._reset()
                    state = self._state(held)
                found = self._extend(state, byte)
            state, change = found
            total += change
        return total

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """The symbols of code points, in which 0x110000 stands between texts."""
        base = self._classes[codes]
        if (base == 255).any():
            for code in np.unique(codes[base == 255]).tolist():
                self._classes[code] = self._class(chr(code))
            base = self._classes[codes]
        out = base.copy()
        follow = np.append(base[1:], END)
        after = np.append(codes[1:], 0x110000)
        seen = (follow != WHITE) & (follow != END)
        white = base == WHITE
        out[white & seen] = LAST
        out[white & seen & (codes == 32)] = SPACE
        out[codes == ord("'")] = QUOTE
        out[np.isin(codes, [ord(c) for c in "stmd"])] = SHORT
        out[(np.isin(codes, [ord("r"), ord("v")]) & (after == ord("e"))) | ((codes == ord("l")) & (after == ord("l")))] = OPEN
        return out

    def _class(self, char: str) -> int:
        """A character's class, as the library's own pre-tokenizer treats it."""
        if char == " ":
            return WHITE
        spans = [span for _, span in self._probe(f"a{char}1")]
        if spans[0][1] > 1:
            return LETTER
        if spans[-1][0] == 1:
            return NUMBER
        return OTHER if self._probe(f"a{char}!")[-1][1][0] == 1 else WHITE

    def _count_stream(self, segments: list[str]) -> np.ndarray:
        joined = "\n".join(segments) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        ends = np.cumsum([len(s) + 1 for s in segments]) - 1
        codes[ends] = 0x110000
        at = piece_starts(self.symbols(codes))
        known = self._pieces
        if len(known) > MAX_PIECES:
            known.clear()
        starts = at.tolist()
        border = np.searchsorted(at, ends)  # what stands between texts starts a piece itself
        pieces = [joined[a:b] for a, b in zip(starts, starts[1:] + [len(joined)])]
        for k in border.tolist():
            pieces[k] = ""
        found = list(map(known.get, pieces))
        if None in found:
            for k, (piece, n) in enumerate(zip(pieces, found)):
                if n is None:
                    n = known.get(piece)
                    if n is None:
                        n = self.count_piece(piece.encode("utf-8"))
                        if len(piece) <= 64:
                            known[piece] = n
                    found[k] = n
        total = np.concatenate(([0], np.cumsum(np.array(found, np.int64))))[border]
        return np.diff(np.concatenate(([0], total)))

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """The token count of each text; special strings inside a text are one token each."""
        out = np.zeros(len(texts), np.int64)
        held: list[str] = []
        owner: list[int] = []
        size = 0

        def flush():
            if held:
                np.add.at(out, owner, self._count_stream(held))
                held.clear()
                owner.clear()

        for k, text in enumerate(texts):
            if not text:
                continue
            parts = [text]
            if self.special is not None and (found := len(self.special.findall(text))):
                parts = [p for p in self.special.split(text) if p]
                out[k] += found
            if held and size + len(text) > STREAM:
                flush()
                size = 0
            held += parts
            owner += [k] * len(parts)
            size += len(text)
        flush()
        return out


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """The compiled tokenizer, once per Python worker."""
    return Tokenizer(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``(doc_id, n_bytes, n_tokens, over_limit)``.

    Counts equal those of the ``tokenizers`` library for the byte-level BPE file ``path`` (readable on
    every executor) without added tokens; special strings inside texts count as one token.  A null or
    empty text has no bytes and no tokens.  Whole texts are counted at any length; repeated rows and
    null ids stay; an empty table gives an empty result; other columns are ignored.
    """
    source = only(docs, doc_id=id_col, text=text_col)

    def run(batches):
        machine = tokenizer(path)
        for batch in batches:
            n_bytes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            n_tokens = pa.array(machine.counts(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n_tokens], ["doc_id", "n_bytes", "n_tokens"])

    counted = source.mapInArrow(run, schema_of(source, ["doc_id"], "n_bytes bigint, n_tokens bigint"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
