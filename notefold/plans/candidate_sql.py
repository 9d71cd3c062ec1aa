"""SQL of all question families: notes as rows, one select per family."""

from __future__ import annotations

from notefold.functions import music as M
from notefold.plans.excerpt_queries import GRID_SQL

NAMES = str(M.NOTE_NAMES)
GRID = "usable and frame_clear and grid_ok"
_VALUES = {"simple": M.VALUE_NAMES_SIMPLE, "compound": M.VALUE_NAMES_COMPOUND}


def notes(cond: str = "true") -> str:
    return f"coalesce(string_agg(cast(i as varchar), ',' order by i) filter (where {cond}), '')"


def count(cond: str) -> str:
    return f"count(*) filter (where {cond})"


def bucket(n: str, top: int = 3) -> str:
    return f"case when {n} >= {top} then '{top}+' else cast({n} as varchar) end"


def or_empty(n: str) -> str:
    return f"case when {n} = 0 then 'empty' else {bucket(n)} end"


def with_empty(name: str, n: str) -> str:
    return f"{name} || case when {n} = 0 then '_empty' else '' end"


def value_name(v: str) -> str:
    of = lambda names: f"case {v} " + " ".join(f"when {k} then '{x}'" for k, x in names.items()) + " end"
    return f"case when meter = '6/8' then {of(M.VALUE_NAMES_COMPOUND)} else {of(M.VALUE_NAMES_SIMPLE)} end"


def family(fam: str, guard: str, sub: str, akey: str, idx: str, params: str = "''", stratum: str = "''", gold: str = "null", more: str = "", having: str = "true") -> str:
    """One family over the notes of the clips that meet the guard; ``more`` adds parameters, which are grouped by."""
    by, source = (f", {more.split('|')[0]}", f", {more.split('|')[1]}") if more else ("", "")
    return f"""select rid, sample_id, '{fam}' as fam, {sub} as sub, {params} as params, {akey} as akey, {stratum} as stratum, {idx} as notes, cast({gold} as varchar) as gold
from f{source} where {guard} group by rid, sample_id, meter, bpb, bd{by} having {having}"""


def _extreme(b: int, name: str) -> str:
    return {
        "highest": f"case when {count(f'bar = {b} and hi{b}')} = 1 then min(i) filter (where bar = {b} and hi{b}) end",
        "lowest": f"case when {count(f'bar = {b} and lo{b}')} = 1 then min(i) filter (where bar = {b} and lo{b}) end",
        "longest": f"any_value(long{b})",
    }[name]


def candidates(cover: float) -> str:
    """All CTEs up to ``cd(rid, sample_id, fam, sub, params, akey, stratum, notes, gold)``."""
    bars, two = "usable and frame_clear and end_ok", "usable and cnt >= 2"
    every, sets = notes(), f"array_to_string(list_transform(pcs, lambda p: {NAMES}[p + 1]), ', ')"
    k6, roots = "k|(select cast(x as integer) as k from range(1, 7) r(x)) kk", "pcs|sc"
    n_of = lambda b: count(f"bar = {b}")
    high = lambda b, f: f"{f}(pitch) filter (where bar = {b})"
    first = lambda b, f: f"min(i) filter (where bar = {b} and {f}{b})"
    bar_len = "'bar' || printf('%.2f', bd)"
    out = [
        family("R-G1", bars, "'bar_start'", "'bar_start'", "min(i) filter (where bar = 1) || ',' || min(i) filter (where bar = 2)"),
        family("R-G2", "tempo_ok and k <= bpb", "'beat=' || k", with_empty("'k' || k", count("grid = k - 1")), notes("grid = k - 1"), "'k=' || k", "'meter' || meter || '|k' || k", more=k6),
        family("R-G3", f"{bars} and grid_ok", "'bar_middle'", with_empty("'mid'", count("grid = bpb / 2")), notes("grid = bpb / 2")),
        family("R-G4", "tempo_ok and values_ok", f"'value=' || replace({value_name('v')}, ' ', '_')", with_empty(value_name("v"), count("val = v")), notes("val = v"), "'value_beats=' || v", "'meter' || meter || '|v' || v", more="v|(select unnest([0.5, 1.0, 1.5, 2.0]::double[]) as v) vv"),
        family("R-G5", "tempo_ok and values_ok and meter in ('2/4', '3/4', '4/4') and not blurred", "'syncopated'", with_empty("'sync'", count("held")), notes("held")),
        *[family("R-G6", f"{bars} and rest_free", f"'longest_bar={b}'", f"'bar{b}'", f"cast(any_value(long{b}) as varchar)", "'min_ratio=1.3'", having=f"any_value(long{b}) is not null") for b in (1, 2)],
        f"""select rid, sample_id, 'R-U3', 'note_value', 'note_index=' || i, {value_name('val')}, 'meter' || meter || '|t' || cast(floor(round(round(st, 6), 2) / 0.5) as integer), cast(i as varchar), {value_name('val')} from f where tempo_ok and values_ok and place <= 5""",
        *[f"""select rid, sample_id, 'R-U4', 'beat_position', 'bar={b};ref_kind={name}', case when pos % 1 = 0 then cast(cast(pos as integer) as varchar) else cast(pos as varchar) end, 'meter' || meter || '|{name}{b}', cast(j as varchar), cast(pos as varchar)
from (select f.rid, f.sample_id, f.meter, f.i as j, f.grid::double + 1 as pos from f join (select rid, {_extreme(b, name)} as j from f where tempo_ok group by rid) x on x.rid = f.rid and x.j = f.i)""" for b in (1, 2) for name in ("highest", "lowest", "longest")],
        family("R-U6", f"{bars} and grid_ok", "'second_half_bar1'", f"cast({count('bar = 1 and grid >= bpb / 2')} as varchar)", notes("bar = 1 and grid >= bpb / 2"), stratum=bar_len, gold=count("bar = 1 and grid >= bpb / 2")),
    ]
    outside = count("not list_contains(pcs, pc)")
    missing = "list_filter(pcs, lambda p: not list_contains(list(pc), p))"
    out += [
        family("T-G1", "usable", "'outside_set'", bucket(outside), notes("not list_contains(pcs, pc)"), f"'set=' || {sets}", more=roots),
        family("T-U1", "usable", "'count_outside'", bucket(outside, 4), notes("not list_contains(pcs, pc)"), f"'set=' || {sets}", gold=outside, more=roots),
        family("T-U2", "usable", "'never_played'", bucket(f"len({missing})"), every, f"'set=' || {sets}", gold=f"to_json(list_transform({missing}, lambda p: {NAMES}[p + 1]))", more=roots),
        family("T-U5", "usable", "'all_in_set'", f"case when {outside} = 0 then 'yes' else 'no' end", f"case when {outside} = 0 then {every} else {notes('not list_contains(pcs, pc)')} end", f"'set=' || {sets}", gold=f"{outside} = 0", more=roots),
        family("T-U3", "usable", "'distinct_names'", "cast(count(distinct pc) as varchar)", every, gold="count(distinct pc)"),
        family("T-U4", "usable", "'list_names'", "cast(count(distinct pc) as varchar)", every, gold=f"to_json(list_transform(list_sort(list_distinct(list(pc))), lambda p: {NAMES}[p + 1]))"),
    ]
    for fam, lo, hi in (("I-G1", 1, 2), ("I-G2", 3, 5), ("I-G3", 6, None)):
        cond = f"abs(mv) >= {lo}" + (f" and abs(mv) <= {hi}" if hi else "")
        out.append(family(fam, two, f"'move={lo}-{hi or 'up'}'", or_empty(count(cond)), notes(cond), f"'lo={lo}" + (f";hi={hi}'" if hi else "'")))
    for way, sign in (("ascending", "mv = k"), ("descending", "mv = -k")):
        out.append(family("I-G4", two, f"'named={way}_' || k", with_empty("'s' || k", count(sign)), notes(sign), f"'semitones=' || k || ';direction={way}'", more="k|(select cast(x as integer) as k from range(1, 13) r(x)) kk"))
    out.append(family("I-G5", two, "'repeated'", f"case when {count('mv = 0')} = 0 then 'empty' else 'rep' end", notes("mv = 0")))
    for r in (1, 2):
        for which in ("highest", "lowest"):
            cond = f"{'high' if which == 'highest' else 'low'}_rank = {r}"
            out.append(family("I-G6", two, f"'pitch_rank={which}{r}'", with_empty(f"'{which}{r}'", count(cond)), notes(cond), f"'rank={r};which={which}'"))
    for way, cond in (("upward", "mv > 0"), ("downward", "mv < 0")):
        out.append(family("I-G7", two, f"'move={way}'", with_empty(f"'{way}'", count(cond)), notes(cond), f"'direction={way}'"))
        out.append(family("I-U3", two, f"'count_{way}'", f"'{way}_' || {bucket(count(cond), 4)}", notes(cond), f"'direction={way}'", f"'{way}'", count(cond)))
    out.append(family("I-U1", two, "'count_semitones'", bucket(count("abs(mv) = k")), notes("abs(mv) = k"), "'semitones=' || k", "'N' || k", count("abs(mv) = k"), more="k|(select cast(x as integer) as k from range(1, 9) r(x)) kk"))
    out.append(family("I-U2", two, "'largest_jump'", "cast(max(abs(mv)) as varchar)", notes("abs(mv) = jump or abs(next_mv) = jump"), gold="max(abs(mv))"))
    out += [family("B-G1", bars, f"'bar_span={b}'", f"'bar{b}'", notes(f"bar = {b}")) for b in (1, 2)]
    out.append(family("B-G2", bars, "'last_note_of_bars'", "'last'", "max(i) filter (where bar = 1) || ',' || max(i) filter (where bar = 2)"))
    out += [family("B-U1", bars, f"'notes_in_bar={b}'", f"cast({n_of(b)} as varchar)", notes(f"bar = {b}"), stratum=bar_len, gold=n_of(b)) for b in (1, 2)]
    more = f"{n_of(2)} - {n_of(1)}"
    out.append(family("B-U2", bars, "'note_count_difference'", f"cast({more} as varchar)", every, gold=more))
    for which, f, mark in (("highest", "max", "hi"), ("lowest", "min", "lo")):
        d = f"{high(2, f)} - {high(1, f)}"
        out.append(family("B-U3", bars, f"'{which}_difference'", f"cast({d} as varchar)", f"{first(1, mark)} || ',' || {first(2, mark)}", gold=d))
    out.append(family("B-U4", bars, "'second_bar_more_notes'", f"case when {more} > 0 then 'yes' else 'no' end", every, gold=f"{more} > 0"))
    tri = bars + " and root1 is not null and root2 is not null"
    name = lambda b: f"{NAMES}[any_value(root{b}) + 1] || ' ' || any_value(kind{b})"
    motion, same = "(any_value(root2) - any_value(root1) + 12) % 12", "any_value(root1) = any_value(root2) and any_value(kind1) = any_value(kind2)"
    foreign = "bar = 2 and not list_contains(pcs1, pc)"
    out.append(family("H-G1", tri, "'bar2_not_in_bar1_triad'", or_empty(count(foreign)), notes(foreign)))
    for b in (1, 2):
        for at, m in enumerate(("root", "third", "fifth"), 1):
            cond = f"bar = {b} and pc = pcs{b}[{at}]"
            out.append(family("H-G2", tri, f"'triad_{m}_bar={b}'", with_empty(f"'{m}'", count(cond)), notes(cond)))
        out.append(family("H-U1", tri, f"'triad_of_bar={b}'", name(b), notes(f"bar = {b}"), gold=name(b)))
        drop, shape = f"bar = {b} and mv < 0 and pbar = bar and lo{b}", f"any_value(shape{b})"
        cycle = f"bar = {b} and kb < case when shape{b} = 'ascending' then 3 else 4 end"
        out.append(family("A-G1", tri, f"'drop_back_bar={b}'", or_empty(count(drop)), notes(drop), f"'bar={b}'", "'meter' || meter"))
        out.append(family("A-U1", tri, f"'drops_to_lowest_bar={b}'", f"cast({count(drop)} as varchar)", notes(drop), stratum="'meter' || meter", gold=count(drop)))
        out.append(family("A-G2", tri, f"'first_cycle_bar={b}'", shape, notes(cycle), f"'bar={b}'", having=f"{shape} is not null"))
        out.append(family("A-U2", tri, f"'pattern_bar={b}'", shape, notes(f"bar = {b}"), gold=f"case when {shape} = 'updown' then 'up-and-down' else {shape} end", having=f"{shape} is not null"))
    out.append(family("H-U2", tri, "'root_motion_up'", f"cast({motion} as varchar)", every, gold=motion))
    out.append(family("H-U3", tri, "'same_triad'", f"case when {same} then 'yes' else 'no' end", every, gold=same))
    paired = bars + " and even"
    out.append(family("Rp-G1", paired, "'bar2_pitch_differs'", or_empty(count("d <> 0")), notes("d <> 0")))
    out.append(family("Rp-G2", paired, "'bar2_pitch_same'", or_empty(count("d = 0")), notes("d = 0")))
    out.append(family("Rp-U1", paired, "'transposition'", "cast(min(d) as varchar)", every, gold="min(d)", having="min(d) = max(d)"))
    out.append(family("Rp-U2", paired, "'n_pitch_differences'", f"cast({count('d <> 0')} as varchar)", notes("d <> 0"), gold=count("d <> 0")))
    return GRID_SQL + f""", slope as (select rid, regr_slope(st, (bar - 1) * bpb + grid) as slope from n group by rid),
sc as (select list_sort(list_transform([0, 2, 4, 5, 7, 9, 11], lambda s: cast((s + root) % 12 as integer))) as pcs from range(0, 12) r(root)),
w(meter, h, weight) as (
  select m, x, case when x = 0 then case when m = '4/4' then 4 else 3 end when m = '4/4' and x = 4 then 3 when x % 2 = 0 then 2 else 1 end from (values ('2/4', 4), ('3/4', 6), ('4/4', 8)) t(m, wide), range(0, 8) r(x) where x < wide),
cross_ as (
  select n.rid, n.i, (a + 2 * n.d - s) / 2 as over from (select *, (bar - 1) * bpb * 2 + cast(grid * 2 as integer) as a from n) n join w w0 on w0.meter = n.meter and w0.h = cast(n.grid * 2 as integer), range(0, 80) r(s), w w1
  where s > a and s <= ceil(a + 2 * n.d) + 1 and w1.meter = n.meter and w1.h = s % (n.bpb * 2) and w1.weight > w0.weight),
blur as (select rid, bool_or(over > 0.1 and over < 0.35) as blurred from cross_ group by rid), held as (select distinct rid, i from cross_ where over >= 0.35),
lo_ as (select rid, bar, i, ioi, row_number() over (partition by rid, bar order by ioi desc, i) as k, lead(ioi) over (partition by rid, bar order by ioi desc, i) as second from n),
longest as (select rid, max(i) filter (where bar = 1 and ioi >= 1.3 * second) as long1, max(i) filter (where bar = 2 and ioi >= 1.3 * second) as long2 from lo_ where k = 1 group by rid),
tri as (select root, kind, list_transform(steps, lambda s: (s + root) % 12) as pcs from range(0, 12) r(root), (values ('major', [0, 4, 7]), ('minor', [0, 3, 7])) k(kind, steps)),
fit as (select rid, bar, root, kind, pcs from (select rid, bar, pc from n) n, tri group by rid, bar, root, kind, pcs
  having count(*) >= 3 and count(*) filter (where list_contains(pcs, pc)) >= {cover} * count(*) and count(distinct pc) filter (where list_contains(pcs, pc)) = 3),
only_ as (select rid, bar, any_value(root) as root, any_value(kind) as kind, any_value(pcs) as pcs from fit group by rid, bar having count(*) = 1),
rk as (select rid, bar, i, pitch, dense_rank() over (partition by rid, bar order by pitch) - 1 as rk, row_number() over (partition by rid, bar order by i) - 1 as k, count(*) over (partition by rid, bar) as m from n),
shape as (select rid, bar, case when max(m) >= 4 and max(rk) = 2 then case when bool_and(rk = k % 3) then 'ascending' when bool_and(rk = [0, 1, 2, 1][k % 4 + 1]) then 'updown' end end as shape from rk group by rid, bar),
pair as (select a.rid, b.i, b.pitch - a.pitch as d from rk a join rk b on a.rid = b.rid and a.bar = 1 and b.bar = 2 and a.k = b.k and a.m = b.m),
refs as (select rid, i, row_number() over (partition by rid order by md5(concat_ws('|', 'refs', sample_id, i)), i) as place from n where abs((round(st, 6) * 100) % 1 - 0.5) >= 0.05),
f as (
  select n.rid, n.sample_id, n.i, n.st, n.bar, n.pitch, n.pc, n.mv, n.pbar, n.grid, n.val, n.low_rank, n.high_rank, c.meter, c.bpb, c.bd, c.cnt, c.usable, c.frame_clear, c.grid_ok, c.end_ok, c.values_ok, c.rest_free,
    coalesce({GRID} and c.cnt >= 4 and slope > 0 and abs(60 / slope - c.bpm) <= 3, false) as tempo_ok, coalesce(blurred, false) as blurred, held.i is not null as held, case when c.rest_free and c.usable and not c.bar_ambiguous then long1 end as long1,
    case when c.rest_free and c.usable and not c.bar_ambiguous then long2 end as long2, a.root as root1, a.kind as kind1, a.pcs as pcs1, b.root as root2, b.kind as kind2, b.pcs as pcs2, s1.shape as shape1, s2.shape as shape2, rk.k as kb, pair.d, refs.place,
    n.bar = 1 and n.pitch = max(n.pitch) filter (where n.bar = 1) over w as hi1, n.bar = 1 and n.pitch = min(n.pitch) filter (where n.bar = 1) over w as lo1, n.bar = 2 and n.pitch = max(n.pitch) filter (where n.bar = 2) over w as hi2,
    n.bar = 2 and n.pitch = min(n.pitch) filter (where n.bar = 2) over w as lo2, max(abs(n.mv)) over w as jump, lead(n.mv) over (partition by n.rid order by n.i) as next_mv, count(pair.d) over w > 0 as even
  from n join c using (rid) left join slope on slope.rid = n.rid left join blur on blur.rid = n.rid left join held on held.rid = n.rid and held.i = n.i left join longest on longest.rid = n.rid
  left join only_ a on a.rid = n.rid and a.bar = 1 left join only_ b on b.rid = n.rid and b.bar = 2 left join shape s1 on s1.rid = n.rid and s1.bar = 1 left join shape s2 on s2.rid = n.rid and s2.bar = 2
  left join rk on rk.rid = n.rid and rk.i = n.i left join pair on pair.rid = n.rid and pair.i = n.i left join refs on refs.rid = n.rid and refs.i = n.i window w as (partition by n.rid)),
cd as ({' union all '.join(out)})
"""
