"""Token counts from a prefix dynamic programme over a BPE piece model.

For a BPE vocabulary the encoding of every prefix is known from its last piece: piece t ends the encoding
of s[:i] exactly when the last piece of s[:i - len(t)] and t stay apart if merged as a pair on their own.
One pass therefore gives last piece and token count at every prefix, and later questions (where does
a budget end, how long is this cut) are look-ups, never another encoding.

No piece of the model joins a character to a following space mark, so a text splits into units, each a run
of space marks and the characters up to the next; a unit splits into segments wherever no piece spans two
neighbouring characters (closing marks). Counts at every prefix are stored per distinct segment, and a text keeps the running sums at its
units' starts: any prefix is one sum and a few look-ups.

Nulls and odd rows: null and empty texts count 0 tokens and 0 bytes. Characters outside the model count
their UTF-8 bytes (byte fallback). Repeated rows give one result row each; a null doc_id stays null. Rows are told apart by nothing else, so
there are no ties. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.scratch import small_batches
from quarry.llm.stores import ENTRY, LONGEST, Store, charge, room

MARK = "▁"
CLOSING = ".,;:!?)%&*#$"
#: Bytes that an answer on two pieces takes, and those that a worker's stores may have here, where every piece of every new word is looked up.
PAIR, ROOM = 120, 256 << 20
LIMIT = 4096


class PrefixCounts(Store):
    """unit without its first space mark -> tokens of the whole unit; prefixes: segment -> tokens at each of its prefixes."""

    def __init__(self, model_file: str):
        super().__init__()
        import ahocorasick
        import sentencepiece as spm

        sp = spm.SentencePieceProcessor(model_file=model_file)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.rank = {sp.id_to_piece(i): (-sp.get_score(i), i) for i in ids}
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("a piece of this model joins a character to a following space mark")
        if sp.encode(" a", out_type=str)[0][0] != MARK or len(sp.encode("  a  ")) < 3:
            raise ValueError("the model must keep all spaces and add one in front")
        self.order = {p: n for n, p in enumerate(sorted(self.rank, key=self.rank.get))}
        #: piece -> True, beginning of one only -> False.
        self.begun = {p[:k]: False for p in self.rank for k in range(1, len(p))} | dict.fromkeys(self.rank, True)
        #: Characters that stand side by side in some piece; no piece spans any other two.
        self.joined = {p[k : k + 2] for p in self.rank for k in range(len(p) - 1)}
        self.ending = ahocorasick.Automaton()
        for p in self.rank:
            self.ending.add_word(p, (p, len(p)))
        self.ending.make_automaton()
        self.whole: dict[str, bool] = {}
        self.apart: dict[str, dict[str, bool]] = defaultdict(dict)
        self.halves: dict[str, tuple[str, str]] = {}
        self.prefixes: dict[str, list[int]] = {}
        self.old_prefixes: dict[str, list[int]] = {}
        self.old_apart: dict[str, dict[str, bool]] = {}

    def merge(self, s: str) -> list[str]:
        """Plain BPE: join the best-ranked adjacent pair, leftmost first, until none is in the model."""
        parts = list(s)
        while True:
            best = min(((self.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None:
                return parts
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def split(self, piece: str) -> tuple[str, str]:
        """The two parts whose join made the piece last."""
        known = self.halves.get(piece)
        if known is None:
            parts = list(piece)
            while len(parts) > 2:
                k = min((self.order[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.order)[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            known = self.halves[piece] = (parts[0], parts[1])
        return known

    def stay_apart(self, a: str, b: str) -> bool:
        """Whether pieces a and b next to each other are what BPE makes of their characters.

        Undo their joins from the last to the first. Between two steps the parts at the border have both been there,
        so if they could join earlier than the step undone last, BPE would have done so. Of equal joins
        the left one comes first.
        """
        order, limit = self.order, 1 << 60
        while True:
            if order.get(a + b, 1 << 60) < limit:
                return False
            x = order[a] if len(a) > 1 else -1
            y = order[b] if len(b) > 1 else -1
            if x > y:
                limit, a = x, self.split(a)[1]
            elif y >= 0:
                limit, b = y + 1, self.split(b)[0]
            else:
                return True

    def table(self, unit: str) -> list[int]:
        """Token counts of unit[:1], unit[:2], ..., of a unit with its space marks.

        Marks that close a word are a segment of their own where no piece joins them to the word. A long unit, as in scripts without spaces,
        is cut wherever no piece joins two neighbours.
        """
        if len(unit) > LONGEST:
            out: list[int] = []
            for s in self.segments(unit):
                base = out[-1] if out else 0
                out += [base + c for c in self.segment(s)]
            return out
        stem = unit.rstrip(CLOSING)
        at = len(stem)
        if not 0 < at < len(unit) or unit[at - 1 : at + 1] in self.joined:
            return self.segment(unit)
        first = self.segment(stem)
        base = first[-1]
        return first + [base + c for c in self.segment(unit[at:])]

    def segments(self, unit: str) -> Iterator[str]:
        """The unit, cut between all neighbours that no piece joins."""
        begin, joined = 0, self.joined
        for k in range(1, len(unit)):
            if unit[k - 1 : k + 1] not in joined:
                yield unit[begin:k]
                begin = k
        yield unit[begin:]

    def segment(self, s: str) -> list[int]:
        known = self.prefixes.get(s)
        if known is None:
            known = self.old_prefixes.get(s) or self.chart(s)
            if len(s) <= LONGEST:
                charge(sys.getsizeof(s) + sys.getsizeof(known) + ENTRY)
                self.prefixes[s] = known
        return known

    def total(self, unit: str) -> int:
        """Tokens of the whole unit; of a long one no table is made."""
        return self.table(unit)[-1] if len(unit) <= LONGEST else sum(self.segment(s)[-1] for s in self.segments(unit))

    def chart(self, s: str) -> list[int]:
        """The programme itself, for a segment: at each prefix, the pieces that end there, found by one automaton."""
        n = len(s)
        count, last, near = [0] * (n + 1), [""] * (n + 1), [None] * (n + 1)
        near[0] = self.whole
        apart = self.apart
        for end, (t, size) in self.ending.iter(s):
            i = end + 1
            if count[i]:
                continue
            j = i - size
            beside = near[j]  # what may stand after the last piece of s[:j]
            if beside is None:
                return self.slow_chart(s)  # a character before it is no piece
            ok = beside.get(t)
            if ok is None:
                ok = beside[t] = self.answer(last[j], t) if j else self.merge(t) == [t]
            if ok:
                count[i] = count[j] + 1
                last[i] = t
                near[i] = apart[t]
        return count[1:] if all(count[1:]) else self.slow_chart(s)

    def reached(self, piece: str) -> bool:
        """Whether BPE makes the piece of its own characters."""
        known = self.whole.get(piece)
        if known is None:
            known = self.whole[piece] = self.merge(piece) == [piece]
        return known

    def slow_chart(self, s: str) -> list[int]:
        """The same where some characters are no pieces: from each prefix, the pieces that may end a longer one."""
        n = len(s)
        count, last = [0] * (n + 1), [""] * (n + 1)
        begun, apart = self.begun, self.apart
        for j in range(n):
            left, base = last[j], count[j] + 1
            near = apart[left]
            for i in range(j + 1, n + 1):
                t = s[j:i]
                whole = begun.get(t)
                if not whole and i == j + 1:  # a character that is no piece: its bytes
                    if not count[i] and (not left or self.stay_apart(left, t)):
                        count[i] = base - 1 + len(t.encode("utf-8", "surrogatepass"))
                        last[i] = t
                if whole is None:
                    break
                if whole and not count[i]:
                    ok = near.get(t)
                    if ok is None:
                        ok = near[t] = self.answer(left, t) if left else self.reached(t)
                    if ok:
                        count[i] = base
                        last[i] = t
        return count[1:]

    def turn(self) -> None:
        super().turn()
        self.old_prefixes, self.prefixes = self.prefixes, {}
        self.old_apart, self.apart = self.apart, defaultdict(dict)

    def answer(self, a: str, b: str) -> bool:
        """stay_apart, unless it was asked in the turn before."""
        charge(PAIR)
        known = self.old_apart.get(a, {}).get(b)
        return self.stay_apart(a, b) if known is None else known

    def __missing__(self, rest: str) -> int:
        n = self.old.get(rest)
        return self.keep(rest, self.total(MARK + rest) if n is None else n, 32)

    def units(self, text: str) -> list[str]:
        """The text's units, each without its first mark."""
        s = text.replace(" ", MARK)
        units = s.split(MARK)
        if "" in units[:-1] and len(units) > 1:
            units = [u[1:] for u in re.findall(f"{MARK}+[^{MARK}]*", MARK + s)]
        return units

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.units(text))) if text else 0

    def within(self, text: str, budget: int) -> int:
        """Code points in the longest prefix of at most `budget` tokens."""
        if not text:
            return 0
        units = self.units(text)
        ends = np.cumsum([self[u] for u in units])
        if ends[-1] <= budget:
            return len(text)
        k = int(np.searchsorted(ends, budget, side="right"))  # the first unit that ends beyond it
        before = int(ends[k - 1]) if k else 0
        start = sum(len(u) + 1 for u in units[:k]) - 1  # of the unit in the text; the mark in front of all isn't in it
        tokens = self.table(MARK + units[k])
        fit = max((i + 1 for i, c in enumerate(tokens) if before + c <= budget), default=0)
        return max(0, start + fit)

    def at_prefixes(self, text: str) -> np.ndarray:
        """Token counts of text[:0], text[:1], ..., text."""
        out, base = [0], 0
        for n, u in enumerate(self.units(text) if text else ()):
            tokens = self.table(MARK + u)
            out += [base + c for c in (tokens if n else tokens[1:])]
            base += tokens[-1]
        return np.array(out)


_MODELS: dict[str, PrefixCounts] = {}


def model(path: str) -> PrefixCounts:
    if path not in _MODELS:
        _MODELS[path] = PrefixCounts(path)
    return _MODELS[path]


def count_tokens(docs: DataFrame, model_file: str | None = None, limit: int = LIMIT, budgets: tuple[int, ...] = ()) -> DataFrame:
    """Per document: bytes, tokens, whether they exceed `limit`, and the code points that fit in it; with `budgets` also `fits`, those that fit in each.

    A narrow map over whole texts. model_file must be readable on every executor; None: the public 32k piece model.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_file is None:
            import public_tokenizers

        m = model(model_file or public_tokenizers.path("piece_bpe_32k.model"))
        with room(ROOM):
            yield from counted(m, batches)

    def counted(m: PrefixCounts, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [m.count(t) for t in texts]
            cut = [len(t) if c <= limit else m.within(t, limit) for t, c in zip(texts, n)]
            cols = [b.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([c > limit for c in n], pa.bool_()), pa.array(cut, pa.int64())]
            if budgets:
                cols.append(pa.array([[len(t) if c <= x else m.within(t, x) for x in budgets] for t, c in zip(texts, n)], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + (", fits array<long>" if budgets else "")
    names = [x.split()[0] for x in schema.split(", ")]
    return small_batches(docs).select("doc_id", "text").mapInArrow(run, schema)
