"""Candidates that hold under jitter, worked out on Arrow batches.

All that timing decides in a clip is discrete: the order of the notes, their bars, half-beats and values, what is syncopated or
longest, and a few flags. A clip is steady if every number that is compared with a limit lies further from it than jitter can
move it: then all copies read alike. The copies of the other clips are analysed as numpy arrays of many clips at once, and only
a copy that reads unlike its clip has its candidates made. They are made here from that reading on plain lists, apart from the
expressions of :mod:`candidates`; the tests compare the two family by family."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa

from notefold.functions import music as M

try:
    from _md5 import md5  # faster than hashlib's on short texts
except ImportError:
    from hashlib import md5

CELLS = 10_000  # notes of the clips that are analysed at once, those left empty included
SIMPLE = ("2/4", "3/4", "4/4")
CONCEPTS = {"R": "rhythm", "T": "tonality", "I": "interval", "B": "bar_comparison", "H": "harmony", "A": "harmonic_pattern", "Rp": "repetition"}
#: what a candidate can be asked for; notes: idx as text
SCHEMA = {"sample_id": "string", "fam": "string", "sub": "string", "params": "string", "idx": "array<int>", "gold": "string", "akey": "string", "kind": "string", "concept": "string", "stratum": "string", "notes": "string"}
#: more of a candidate: whether it has no notes, and whether it is the first of its clip of its family, class, stratum and ``empty``
MORE = {"empty": "boolean", "fresh": "boolean"}


# -- numbers as Spark compares them: NaN equals itself and is greater than any other --------------------
def _gt(a, b):
    return (a > b) | (np.isnan(a) & ~np.isnan(b))


def _le(a, b):
    return ~_gt(a, b)


def _rounded(x: float, places: str) -> float:
    return float(Decimal(repr(x)).quantize(Decimal(places), ROUND_HALF_UP))


# -- reading ---------------------------------------------------------------------------------------------
class Frames:
    """Frames of clips, a row each; ``spb`` and ``bpb`` are NaN where they are not known."""

    def __init__(self, n, meter, bpm, start, bar):
        self.n, self.meter, self.bpm, self.start, self.bar = n, meter, bpm, start, bar
        with np.errstate(all="ignore"):
            self.spb = np.where(bpm == 0, np.nan, 60.0 / bpm)
        self.bpb = np.array([M.BEATS_PER_BAR.get(m, np.nan) for m in meter], float)
        self.simple = np.array([m in SIMPLE for m in meter], bool)
        self.four = np.array([m == "4/4" for m in meter], bool)

    def only(self, rows) -> Frames:
        return Frames(self.n[rows], self.meter[rows], self.bpm[rows], self.start[rows], self.bar[rows])


def _total(x):
    """Sums of rows from left to right, as an aggregate adds them."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out = out + x[:, k]
    return out


def _weight(h, four):
    return np.where(h == 0, np.where(four, 4, 3), np.where(four & (h == 4), 3, np.where(h % 2 == 0, 2, 1)))


# the first five by note, the others by clip; longest: by bar
READ = ("pitch", "bar", "grid", "value", "sync", "longest", "usable", "frame_full", "on_grid", "values_ok", "tempo", "ambiguous", "sync_ok")


def reading(start, end, pitch, f: Frames, width: float | None = None) -> dict:
    """What the families see of clips (rows of notes by start, end and pitch): the arrays ``READ``, zero where no family looks.

    With ``width`` also ``steady``: usable clips that read alike when every start and end moves by up to ``width``."""
    rows, most_notes = start.shape
    col = np.arange(most_notes)
    own = col < f.n[:, None]
    each, row = (lambda c: np.all(c | ~own, axis=1)), (lambda v: v[:, None])
    any_of = lambda c: np.any(c & own, axis=1)
    with np.errstate(all="ignore"):
        line, piece_end = f.start + f.bar, f.start + 2 * f.bar
        edge = f.start + f.bar - M.FRAME_TOL
        first_bar = _gt(row(edge), start) & own
        ones = first_bar.sum(axis=1)
        start1, start2 = start[:, 0], start[np.arange(rows), np.minimum(ones, most_notes - 1)]
        following = np.concatenate([start[:, 1:], np.full((rows, 1), np.nan)], axis=1)
        inner = col < f.n[:, None] - 1  # notes with one after them
        ultra = any_of(_gt(M.SHORTEST_NOTE, end - start))
        overlap = np.any(_gt(end, following + 1e-4) & inner, axis=1)
        usable = ~ultra & ~overlap & (ones > 0) & (ones < f.n)
        ambiguous = any_of(_gt(start, row(line - 0.16)) & _gt(row(line - 0.04), start))
        clear = _le(np.abs(start1 - f.start), M.FRAME_TOL) & _le(np.abs(start2 - line), M.FRAME_TOL) & ~ambiguous
        pos = (start - np.where(first_bar, row(start1), row(start2))) / row(f.spb)
        grid = np.rint(pos * 2) / 2
        grid_ok = each(_le(np.abs(pos - grid), M.GRID_TOL)) & ~np.isnan(f.spb)
        ioi = np.where(inner, following, row(piece_end)) - start
        beats = ioi / row(f.spb)
        off = np.stack([np.abs(v - beats) for v in M.NOTE_VALUES])
        nearest = np.argmin(np.where(np.isnan(off), np.inf, off), axis=0)
        near = _le(np.min(off, axis=0), M.GRID_TOL)
        value = np.where(near, np.array(M.NOTE_VALUES)[nearest], 0.0)
        gaps = np.all(_le(following - end, M.REST_TOL) | ~inner, axis=1)
        end_ok = _le(np.abs(piece_end - end[np.arange(rows), f.n - 1]), M.END_TOL)
        rest_free = (f.n > 1) & gaps & end_ok
        values_ok = rest_free & each(near)
        on_grid = usable & clear & grid_ok

        # tempo: least-squares slope of onsets over places
        xs = np.where(own, np.where(first_bar, 0.0, row(f.bpb)) + grid, 0.0)
        at = np.where(own, start, 0.0)
        mx, mt = _total(xs) / f.n, _total(at) / f.n
        dx, dt = np.where(own, xs - row(mx), 0.0), np.where(own, at - row(mt), 0.0)
        square = _total(dx * dx)
        slope = np.where(square == 0, np.nan, _total(dx * dt) / square)
        tempo = on_grid & (f.n >= 4) & (slope > 0) & (np.abs(60.0 / slope - f.bpm) <= M.TEMPO_TOL)

        # syncopation: a note that is held through a stronger half-beat
        asked = on_grid & values_ok & f.simple & tempo
        own_half = np.where(own & row(asked), np.rint(grid * 2), 0).astype(int)
        wide = np.where(f.simple, 2 * np.nan_to_num(f.bpb, nan=1), 2).astype(int)
        a = np.where(first_bar, 0, row(wide)) + own_half
        q, mine = a + 2 * ioi / row(f.spb), _weight(own_half, row(f.four))
        held, blurred, near_sync = np.zeros_like(own), np.zeros(rows, bool), np.full(rows, np.inf)
        for k in range(1, 9):  # the longest value is three beats
            stronger = (_weight((a + k) % row(wide), row(f.four)) > mine) & own
            c = (q - (a + k)) / 2
            blurred |= np.any(stronger & (c > M.SYNC_LOW) & (c < M.SYNC_HIGH), axis=1)
            held |= stronger & (c >= M.SYNC_HIGH)
            if width is not None:
                near_sync = np.minimum(near_sync, np.min(np.where(stronger, np.minimum(np.abs(c - M.SYNC_LOW), np.abs(c - M.SYNC_HIGH)), np.inf), axis=1))
        sync_ok = asked & ~blurred

        longest = np.full((rows, 2), -1)
        for b, here in enumerate((first_bar, own & ~first_bar)):
            length = np.where(here, ioi, -np.inf)
            top = np.argmax(length, axis=1)
            most = length[np.arange(rows), top]
            length[np.arange(rows), top] = -np.inf
            leads = ~_gt(1.3 * np.max(length, axis=1), most) & (here.sum(axis=1) >= 2) & usable & ~ambiguous & rest_free
            longest[leads, b] = top[leads]
    out = {
        "pitch": np.where(own, pitch, 0), "bar": np.where(own, np.where(first_bar, 1, 2), 0), "grid": np.where(own & row(on_grid), grid, 0.0), "value": np.where(own & row(values_ok), value, 0.0),
        "sync": held & row(sync_ok), "longest": longest, "usable": usable, "frame_full": clear & end_ok, "on_grid": on_grid, "values_ok": values_ok, "tempo": tempo, "ambiguous": ambiguous, "sync_ok": sync_ok,
    }
    if width is None:
        return out
    # A copy's end is cut at the next onset, which a usable clip's end passes by 0.1 ms at most. What is false with room to spare needs no more looks at what it rules out.
    w, cut = 1.001 * width + 1e-6, 1e-4
    far = lambda x, limit, slack: np.abs(x - limit) > slack
    with np.errstate(all="ignore"):
        moved = 2 * w / np.abs(f.spb)
        steady = usable & np.isfinite(moved) & each(far(start, row(edge), w) & far(end - start, M.SHORTEST_NOTE, 2 * w + cut))
        steady &= each(far(start, row(line - 0.16), w) & far(start, row(line - 0.04), w))
        steady &= far(np.abs(start1 - f.start), M.FRAME_TOL, w) & far(np.abs(start2 - line), M.FRAME_TOL, w)
        steady &= each(far(np.abs(pos - grid), M.GRID_TOL, row(moved)) & (np.abs(pos - grid) + row(moved) < 0.25))  # no note takes another half-beat
        steady &= each(np.all(far(off, M.GRID_TOL, row(moved)), axis=0))
        steady &= np.all(far(following - end, M.REST_TOL, 2 * w + cut) | ~inner, axis=1) & far(np.abs(piece_end - end[np.arange(rows), f.n - 1]), M.END_TOL, w + cut)
        drift = w * _total(np.abs(dx)) / square  # the most by which the slope moves
        least, most = 60.0 / (slope + drift) - f.bpm, 60.0 / (slope - drift) - f.bpm
        steady &= ~(on_grid & (f.n >= 4)) | ((slope > drift) & (np.maximum(np.abs(least), np.abs(most)) < M.TEMPO_TOL - 1e-6)) | ((slope > drift) & ((least > M.TEMPO_TOL + 1e-6) | (most < -M.TEMPO_TOL - 1e-6)))
        steady &= ~asked | (near_sync > np.where(asked, moved, 0))
        for b, here in enumerate((first_bar, own & ~first_bar)):
            length = np.sort(np.where(here, ioi, -np.inf), axis=1)
            steady &= (here.sum(axis=1) < 2) | far(length[:, -1] - 1.3 * length[:, -2:-1].sum(axis=1), 0, 4.6 * w)
    return out | {"steady": steady}


def _in_order(start, end, pitch, n):
    """Notes of jittered copies by start, end and pitch; rows that are in order stay as they are."""
    inner = np.arange(start.shape[1] - 1) < n[:, None] - 1
    for r in np.flatnonzero(np.any(~(start[:, :-1] < start[:, 1:]) & inner, axis=1)):
        k = np.lexsort((pitch[r, : n[r]], end[r, : n[r]], start[r, : n[r]]))
        for x in (start, end, pitch):
            x[r, : n[r]] = x[r, k]
    return start, end, pitch


def _shifts(ids, n, draws: int, width: float, what: str):
    """By how much the notes of each copy move: draws × clips × notes, fixed by clip, draw and note."""
    top = int(n.max())
    out = np.zeros((draws, len(n), top))
    tails = [[f"{d}|{i}".encode() for i in range(top)] for d in range(1, draws + 1)]
    for r, (sample_id, m) in enumerate(zip(ids, n.tolist())):
        head = f"{what}|".encode() if sample_id is None else f"{what}|{sample_id}|".encode()
        h = np.frombuffer(b"".join([md5(head + t).digest() for own in tails for t in own[:m]]), ">u4").reshape(draws, m, 4)[:, :, 0]
        out[:, r, :m] = h
    return (out / 4294967295.0 * 2 - 1) * width


# -- families -------------------------------------------------------------------------------------------
FORMS: dict[tuple, int] = {}  # numbers of the fixed parts of candidates: family, sub and params


def form(fam: str, sub: str, params: str = "") -> int:
    return FORMS.setdefault((fam, sub, params), len(FORMS))


def _form_columns() -> dict:
    fam, sub, params = zip(*FORMS)
    kind = ["grounding" if f.split("-")[1][0] == "G" else "understanding" for f in fam]
    return {"fam": fam, "sub": sub, "params": params, "kind": kind, "concept": [CONCEPTS[f.split("-")[0]] for f in fam]}


ORDER = range(12)
SCALES = [sorted((r + s) % 12 for s in M.MAJOR_STEPS) for r in ORDER]
OUTSIDE = [frozenset(range(12)) - frozenset(s) for s in SCALES]
SETS = ["set=" + ", ".join(M.NOTE_NAMES[p] for p in s) for s in SCALES]
TRIADS = [(r, k, [(r + s) % 12 for s in steps]) for r in ORDER for k, steps in M.TRIADS.items()]


def _bucket(n: int, top: int = 3) -> str:
    return f"{top}+" if n >= top else str(n)


def _or_empty(idx) -> str:
    return _bucket(len(idx)) if idx else "empty"


def _empty(idx, name: str) -> str:
    return name if idx else name + "_empty"


def _names(classes) -> str:
    return "[" + ",".join(f'"{M.NOTE_NAMES[p]}"' for p in classes) + "]"


def _yes(c: bool) -> tuple[str, str]:
    return ("yes", "true") if c else ("no", "false")


class Read:
    """What one clip or copy of it reads as; ``start`` only of a clip itself."""

    def __init__(self, x: dict, r: int, n: int, meter: str | None, bar_length: str | None, sample_id: str | None, start=None):
        self.n, self.meter, self.bar_length, self.sample_id, self.start = n, meter, bar_length, sample_id, start
        self.pitch, self.bar, self.grid, self.value = (x[k][r, :n].tolist() for k in ("pitch", "bar", "grid", "value"))
        self.frame_full, self.on_grid, self.values_ok, self.tempo, self.ambiguous = (bool(x[k][r]) for k in ("frame_full", "on_grid", "values_ok", "tempo", "ambiguous"))
        self.sync = np.flatnonzero(x["sync"][r, :n]).tolist() if x["sync_ok"][r] else None
        self.longest = [None if k < 0 else k for k in x["longest"][r].tolist()]
        self.bpb, self.all = M.BEATS_PER_BAR.get(meter), tuple(range(n))
        ones = self.bar.count(1)
        self.of = {1: self.all[:ones], 2: self.all[ones:]}
        self.moves = [b - a for a, b in zip(self.pitch, self.pitch[1:])]
        self.pc = [p % 12 for p in self.pitch]
        self.triads: dict = {}
        self.names = M.VALUE_NAMES_COMPOUND if meter == "6/8" else M.VALUE_NAMES_SIMPLE

    def metered(self, text: str = "") -> str | None:
        return None if self.meter is None else f"meter{self.meter}{text}"

    def triad(self, b: int, cover: float):
        if b not in self.triads:
            heard = [self.pc[i] for i in self.of[b]]
            played = set(heard)
            fits = [t for t in TRIADS if played.issuperset(t[2]) and sum(heard.count(p) for p in t[2]) >= cover * len(heard)]
            self.triads[b] = fits[0] if len(fits) == 1 and len(heard) >= 3 else None
        return self.triads[b]


# each gives (form, akey, stratum, idx, gold) of its candidates
def rhythm_grounding(s: Read, cover: float):
    if s.frame_full:
        idx = (0, s.of[2][0])
        yield form("R-G1", "bar_start"), "bar_start", "", idx, None
        if s.on_grid:
            idx = tuple(i for i in s.all if s.bpb and s.grid[i] == s.bpb / 2)
            yield form("R-G3", "bar_middle"), _empty(idx, "mid"), "", idx, None
        for b in (1, 2):
            if s.longest[b - 1] is not None:
                yield form("R-G6", f"longest_bar={b}", "min_ratio=1.3"), f"bar{b}", "", (s.longest[b - 1],), None
    if s.tempo:
        for k in range(1, min(6, s.bpb) + 1):
            idx = tuple(i for i in s.all if s.grid[i] == k - 1)
            yield form("R-G2", f"beat={k}", f"k={k}"), _empty(idx, f"k{k}"), s.metered(f"|k{k}"), idx, None
        if s.values_ok:
            for v in (0.5, 1.0, 1.5, 2.0):
                name, idx = s.names[v], tuple(i for i in s.all if s.value[i] == v)
                yield form("R-G4", "value=" + name.replace(" ", "_"), f"value_beats={v}"), _empty(idx, name), s.metered(f"|v{v}"), idx, None
        if s.sync is not None:
            yield form("R-G5", "syncopated"), _empty(s.sync, "sync"), "", tuple(s.sync), None


def rhythm_understanding(s: Read, cover: float):
    if s.start is not None and s.tempo and s.values_ok:
        # five notes in hash order, none whose onset is near the border of two decimals
        at = [_rounded(x, "0.000001") for x in s.start]
        clear = [i for i in s.all if abs(math.fmod(math.fmod(at[i] * 100, 1.0) + 1.0, 1.0) - 0.5) >= 0.05] if min(at) < 0 else [i for i in s.all if abs(math.fmod(at[i] * 100, 1.0) - 0.5) >= 0.05]
        head = "refs|" if s.sample_id is None else f"refs|{s.sample_id}|"
        for _, i in sorted((md5(f"{head}{i}".encode()).hexdigest(), i) for i in clear)[:5]:
            name = s.names[s.value[i]]
            yield form("R-U3", "note_value", f"note_index={i}"), name, s.metered(f"|t{math.floor(_rounded(at[i], '0.01') / 0.5)}"), (i,), name
    if s.tempo and not s.ambiguous:
        for b in (1, 2):
            of = [s.pitch[i] for i in s.of[b]]
            for name, pick in (("highest", max), ("lowest", min), ("longest", None)):
                if pick is None:
                    one = s.longest[b - 1]
                else:
                    top = pick(of)
                    one = s.of[b][of.index(top)] if of.count(top) == 1 else None
                if one is not None:
                    at = s.grid[one] + 1.0
                    yield form("R-U4", "beat_position", f"bar={b};ref_kind={name}"), str(int(at)) if at % 1 == 0 else str(at), s.metered(f"|{name}{b}"), (one,), str(at)
    if s.frame_full and s.on_grid:
        idx = tuple(i for i in s.of[1] if s.bpb and s.grid[i] >= s.bpb / 2)
        yield form("R-U6", "second_half_bar1"), str(len(idx)), s.bar_length, idx, str(len(idx))


_OF_SET = [tuple(form(fam, sub, known) for fam, sub in (("T-G1", "outside_set"), ("T-U1", "count_outside"), ("T-U5", "all_in_set"), ("T-U2", "never_played"))) for known in SETS]
_NAMES_PLAYED = form("T-U3", "distinct_names"), form("T-U4", "list_names")


@cache
def _missing(played: frozenset) -> list[tuple]:
    """Of each scale what is not among the classes played, as akey and gold."""
    return [(_bucket(len(m)), _names(m)) for m in ([p for p in s if p not in played] for s in SCALES)]


def tonality(s: Read, cover: float):
    played, found = frozenset(s.pc), []
    for (outside, count, all_in, never), out, (akey, gold) in zip(_OF_SET, OUTSIDE, _missing(played)):
        if played.isdisjoint(out):
            found += (outside, "0", "", (), None), (count, "0", "", (), "0"), (all_in, "yes", "", s.all, "true")
        else:
            idx = tuple([i for i, p in enumerate(s.pc) if p in out])
            n = len(idx)
            found += (outside, _bucket(n), "", idx, None), (count, _bucket(n, 4), "", idx, str(n)), (all_in, "no", "", idx, "false")
        found.append((never, akey, "", s.all, gold))
    n = str(len(played))
    found += (_NAMES_PLAYED[0], n, "", s.all, n), (_NAMES_PLAYED[1], n, "", s.all, _names(sorted(played)))
    return found


_SIZED = [(form(fam, f"move={lo}-{hi or 'up'}", f"lo={lo}" + (f";hi={hi}" if hi else "")), lo, hi or math.inf) for fam, lo, hi in (("I-G1", 1, 2), ("I-G2", 3, 5), ("I-G3", 6, None))]
_NAMED = [(k * sign, f"s{k}", form("I-G4", f"named={way}_{k}", f"semitones={k};direction={way}")) for way, sign in (("ascending", 1), ("descending", -1)) for k in range(1, 13)]
_NAMED_EMPTY = [(f, f"{akey}_empty", "", (), None) for _, akey, f in _NAMED]
_RANKED = [(r, which, f"{which}{r}", form("I-G6", f"pitch_rank={which}{r}", f"rank={r};which={which}")) for r in (1, 2) for which in ("highest", "lowest")]
_COUNTED = [(k, f"N{k}", form("I-U1", "count_semitones", f"semitones={k}")) for k in range(1, 9)]
_COUNTED_NONE = [(f, "0", stratum, (), "0") for _, stratum, f in _COUNTED]
_WAYS = [(d, form("I-G7", f"move={d}", f"direction={d}"), form("I-U3", f"count_{d}", f"direction={d}")) for d in ("upward", "downward")]
_REPEATED, _JUMP = form("I-G5", "repeated"), form("I-U2", "largest_jump")


def intervals(s: Read, cover: float):
    if s.n < 2:
        return ()
    by: dict[int, list[int]] = {}
    for i, m in enumerate(s.moves, 1):
        by.setdefault(m, []).append(i)
    sizes = [abs(m) for m in s.moves]
    found = []
    for f, lo, hi in _SIZED:
        idx = tuple([i for i, m in enumerate(sizes, 1) if lo <= m <= hi])
        found.append((f, _or_empty(idx), "", idx, None))
    for (m, akey, f), none in zip(_NAMED, _NAMED_EMPTY):
        found.append((f, akey, "", tuple(by[m]), None) if m in by else none)
    idx = tuple(by.get(0, ()))
    found.append((_REPEATED, "rep" if idx else "empty", "", idx, None))
    low = sorted(set(s.pitch))
    for r, which, akey, f in _RANKED:
        at = None if r > len(low) else low[-r] if which == "highest" else low[r - 1]
        idx = () if at is None else tuple([i for i, p in enumerate(s.pitch) if p == at])
        found.append((f, _empty(idx, akey), "", idx, None))
    up, down = (tuple([i for i, m in enumerate(s.moves, 1) if m * sign > 0]) for sign in (1, -1))
    for (d, reached, count), idx in zip(_WAYS, (up, down)):
        found += (reached, _empty(idx, d), "", idx, None), (count, f"{d}_{_bucket(len(idx), 4)}", d, idx, str(len(idx)))
    for (k, stratum, f), none in zip(_COUNTED, _COUNTED_NONE):
        idx = by.get(k, []) + by.get(-k, [])
        found.append((f, _bucket(len(idx)), stratum, tuple(sorted(idx)), str(len(idx))) if idx else none)
    jump = max(sizes)
    tied = {j for i, m in enumerate(sizes, 1) if m == jump for j in (i - 1, i)}
    found.append((_JUMP, str(jump), "", tuple(sorted(tied)), str(jump)))
    return found


def bars(s: Read, cover: float):
    if not s.frame_full:
        return
    one, two = s.of[1], s.of[2]
    more = len(two) - len(one)
    for b in (1, 2):
        yield form("B-G1", f"bar_span={b}"), f"bar{b}", "", s.of[b], None
        yield form("B-U1", f"notes_in_bar={b}"), str(len(s.of[b])), s.bar_length, s.of[b], str(len(s.of[b]))
    yield form("B-G2", "last_note_of_bars"), "last", "", (one[-1], two[-1]), None
    yield form("B-U2", "note_count_difference"), str(more), "", s.all, str(more)
    for name, pick in (("highest", max), ("lowest", min)):
        a, b = (pick(s.pitch[i] for i in of) for of in (one, two))
        idx = (s.pitch.index(a, 0), s.pitch.index(b, two[0]))
        yield form("B-U3", f"{name}_difference"), str(b - a), "", idx, str(b - a)
    yes, true = _yes(more > 0)
    yield form("B-U4", "second_bar_more_notes"), yes, "", s.all, true


def harmony(s: Read, cover: float):
    t = {b: s.triad(b, cover) for b in (1, 2)} if s.frame_full else {}
    if not t or None in t.values():
        return
    idx = tuple(i for i in s.of[2] if s.pc[i] not in t[1][2])
    yield form("H-G1", "bar2_not_in_bar1_triad"), _or_empty(idx), "", idx, None
    for b in (1, 2):
        for m, p in zip(("root", "third", "fifth"), t[b][2]):
            idx = tuple(i for i in s.of[b] if s.pc[i] == p)
            yield form("H-G2", f"triad_{m}_bar={b}"), _empty(idx, m), "", idx, None
        name = f"{M.NOTE_NAMES[t[b][0]]} {t[b][1]}"
        yield form("H-U1", f"triad_of_bar={b}"), name, "", s.of[b], name
    motion = str((t[2][0] - t[1][0]) % 12)
    yield form("H-U2", "root_motion_up"), motion, "", s.all, motion
    yes, true = _yes(t[1] == t[2])
    yield form("H-U3", "same_triad"), yes, "", s.all, true


def patterns(s: Read, cover: float):
    if not s.frame_full or s.triad(1, cover) is None or s.triad(2, cover) is None:
        return
    for b in (1, 2):
        own = s.of[b]
        heights = sorted({s.pitch[i] for i in own})
        idx = tuple(i for i in own[1:] if s.pitch[i] == heights[0] and s.moves[i - 1] < 0)
        yield form("A-G1", f"drop_back_bar={b}", f"bar={b}"), _or_empty(idx), s.metered(), idx, None
        yield form("A-U1", f"drops_to_lowest_bar={b}"), str(len(idx)), s.metered(), idx, str(len(idx))
        if len(own) >= 4 and len(heights) == 3:
            ranks = [heights.index(s.pitch[i]) for i in own]
            for kind, label, cycle in (("ascending", "ascending", (0, 1, 2)), ("updown", "up-and-down", (0, 1, 2, 1))):
                if all(x == cycle[k % len(cycle)] for k, x in enumerate(ranks)):
                    yield form("A-G2", f"first_cycle_bar={b}", f"bar={b}"), kind, "", own[: len(cycle)], None
                    yield form("A-U2", f"pattern_bar={b}"), kind, "", own, label


def repetition(s: Read, cover: float):
    one, two = s.of[1], s.of[2]
    if not s.frame_full or len(one) != len(two):
        return
    d = [s.pitch[b] - s.pitch[a] for a, b in zip(one, two)]
    differ, same = tuple(b for b, x in zip(two, d) if x), tuple(b for b, x in zip(two, d) if not x)
    yield form("Rp-G1", "bar2_pitch_differs"), _or_empty(differ), "", differ, None
    yield form("Rp-G2", "bar2_pitch_same"), _or_empty(same), "", same, None
    if len(set(d)) == 1:
        yield form("Rp-U1", "transposition"), str(d[0]), "", s.all, str(d[0])
    yield form("Rp-U2", "n_pitch_differences"), str(len(differ)), "", differ, str(len(differ))


GENERATORS = {f.__name__: f for f in (rhythm_grounding, rhythm_understanding, tonality, intervals, bars, harmony, patterns, repetition)}


# -- clips ------------------------------------------------------------------------------------------------
def _kept(own: list[tuple], values: list[tuple], copies: list[Read], families, cover: float) -> list[tuple]:
    """Candidates that every copy gives too; of a note's value, which is asked of other notes in each copy, those whose note has the same value there."""
    for s in copies:
        there = {(k, idx, gold) for f in families for k, _, _, idx, gold in f(s, cover)}
        own = [c for c in own if (c[0], c[3], c[4]) in there]
        values = [c for c in values if s.tempo and s.values_ok and s.names[s.value[c[3][0]]] == c[4]]
    return own + values


def _stable_of(ids, meters, lengths, f: Frames, start, end, pitch, families, draws: int, width: float, cover: float):
    """Per clip with candidates its row and those that are stable."""
    base = reading(start, end, pitch, f, width)
    rows = np.flatnonzero(base["usable"])
    base, holds, unlike = {k: v[rows] for k, v in base.items()}, np.ones(len(rows), bool), {}
    loose = np.flatnonzero(~base["steady"])
    if len(loose):
        at = rows[loose]
        own, top = f.only(at), int(f.n[at].max())
        by_start, by_end = (_shifts([ids[r] for r in at], own.n, draws, width, what) for what in "se")
        first = {k: v[loose, :top] if k in READ[:5] else v[loose] for k, v in base.items()}
        inner = np.arange(top) < own.n[:, None] - 1
        for d in range(draws):
            s = start[at, :top] + by_start[d]
            after = np.where(inner, np.concatenate([s[:, 1:], s[:, :1]], axis=1), np.nan)
            e = np.maximum(np.fmin(end[at, :top] + by_end[d], after), s + 0.05)
            x = reading(*_in_order(s, e, pitch[at, :top].copy(), own.n), own)
            holds[loose] &= x["usable"]
            same = np.ones(len(loose), bool)
            for k in READ:
                same &= np.all(x[k] == first[k], axis=1) if x[k].ndim == 2 else x[k] == first[k]
            for r in np.flatnonzero(~same):
                unlike.setdefault(int(loose[r]), []).append((x, r))
    for k in np.flatnonzero(holds):
        r = rows[k]
        n = int(f.n[r])
        s = Read(base, k, n, meters[r], lengths[r], ids[r], start[r, :n].tolist())
        own = [c for g in families for c in g(s, cover)]
        if k in unlike:
            value_forms = {v for name, v in FORMS.items() if name[0] == "R-U3"}
            values, own = [c for c in own if c[0] in value_forms], [c for c in own if c[0] not in value_forms]
            copies = {tuple(x[c][j].tobytes() for c in READ): (x, j) for x, j in unlike[k]}
            own = _kept(own, values, [Read(x, j, n, meters[r], lengths[r], ids[r]) for x, j in copies.values()], families, cover)
        yield r, own


def _fresh(cs: list[tuple], fam) -> list[bool]:
    seen: set = set()
    return [not (key in seen or seen.add(key)) for key in ((fam[no], akey, stratum, not idx) for no, akey, stratum, idx, _ in cs)]


def _batch(ids, found: list[tuple], fields):
    no, akey, stratum, lists, gold = zip(*chain.from_iterable(cs for _, cs in found))
    no, known = pa.array(no, pa.int32()), _form_columns()
    free = {"akey": akey, "stratum": stratum, "gold": gold}

    def column(k: str):
        if k in known:
            return pa.array(known[k], pa.string()).take(no)
        if k in free:
            return pa.array(free[k], pa.string())
        if k == "empty":
            return pa.array([not x for x in lists], pa.bool_())
        if k == "fresh":
            return pa.array(list(chain.from_iterable(_fresh(cs, known["fam"]) for _, cs in found)), pa.bool_())
        if k == "notes":
            text = {x: ",".join(map(str, x)) for x in set(lists)}
            return pa.array([text[x] for x in lists], pa.string())
        if k == "idx":
            ends = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=ends[1:])
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(lists), np.int32, int(ends[-1]))))
        return pa.array([ids[r] for r, _ in found], pa.string()).take(pa.array(np.repeat(np.arange(len(found)), [len(cs) for _, cs in found])))

    return pa.RecordBatch.from_arrays([column(k) for k in fields], list(fields))


def stable_batches(batches, generators: list[str] | None, draws: int, width: float, cover: float, fields=tuple(SCHEMA)):
    """The ``fields`` of stable candidates, of batches of ``sample_id, notes`` in order, ``meter, bpm, music_start, bar_dur`` and the bar's length as text."""
    families = [GENERATORS[g] for g in generators or GENERATORS]
    for b in batches:
        ids, meters, lengths = (b.column(k).to_pylist() for k in (0, 2, 6))
        bpm, at, bar = (np.array(b.column(k).to_pylist(), dtype=float) for k in (3, 4, 5))
        framed = np.array(b.column(4).is_valid()) & np.array(b.column(5).is_valid())
        notes = b.column(1)
        counts, flat = np.array(notes.value_lengths().fill_null(0)), notes.flatten()
        first = np.concatenate([[0], np.cumsum(counts)])
        start, end, pitch = (np.array(flat.field(k)) for k in range(3))
        order = np.flatnonzero((counts > 0) & framed)  # without two bars there is nothing to ask
        order = order[np.argsort(counts[order], kind="stable")]
        while len(order):
            top = np.maximum.accumulate(counts[order]) * np.arange(1, len(order) + 1)
            own, order = np.split(order, [max(1, int(np.searchsorted(top, CELLS, "right")))])
            n, wide = counts[own], int(counts[own].max())
            take = np.minimum(first[own][:, None] + np.arange(wide), (first[own] + n - 1)[:, None])
            f = Frames(n, np.array([meters[r] for r in own], object), bpm[own], at[own], bar[own])
            names = [ids[r] for r in own]
            found = [x for x in _stable_of(names, [meters[r] for r in own], [lengths[r] for r in own], f, start[take], end[take], pitch[take].astype(np.int64), families, draws, width, cover) if x[1]]
            if found:
                yield _batch(names, found, fields)
