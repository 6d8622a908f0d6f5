"""The queries of `polyad.queries` in SQL for DuckDB, from named common table expressions."""

from __future__ import annotations

CTE = {
    "nk": "SELECT n_nationkey AS k, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INT) AS i FROM (SELECT DISTINCT n_nationkey FROM nation)",
    "pt": "SELECT p_type AS k, CAST(row_number() OVER (ORDER BY p_type) - 1 AS INT) AS i FROM (SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL)",
    "mo": "SELECT CAST(range + 1 AS INT) AS k, CAST(range AS INT) AS i FROM range(12)",
    "sold": "SELECT s_nationkey, p_type, month(l_shipdate) AS m, sum(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL",
    "tensor": "SELECT nk.i AS i0, pt.i AS i1, mo.i AS i2, CAST(coalesce(v, 0) AS DOUBLE) AS val FROM nk CROSS JOIN pt CROSS JOIN mo LEFT JOIN sold ON s_nationkey = nk.k AND p_type = pt.k AND m = mo.k",
    "rg": "SELECT n_regionkey AS k, CAST(row_number() OVER (ORDER BY n_regionkey) - 1 AS INT) AS i FROM (SELECT DISTINCT n_regionkey FROM nation)",
    "fl": "SELECT l_returnflag AS k, CAST(row_number() OVER (ORDER BY l_returnflag) - 1 AS INT) AS i FROM (SELECT DISTINCT l_returnflag FROM lineitem)",
    "yr": "SELECT y AS k, CAST(row_number() OVER (ORDER BY y) - 1 AS INT) AS i FROM (SELECT DISTINCT year(l_shipdate) AS y FROM lineitem)",
    "sold4": "SELECT n_regionkey, p_type, l_returnflag, year(l_shipdate) AS y, sum(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL",
    "tensor4": "SELECT rg.i AS i0, pt.i AS i1, fl.i AS i2, yr.i AS i3, CAST(coalesce(v, 0) AS DOUBLE) AS val FROM rg CROSS JOIN pt CROSS JOIN fl CROSS JOIN yr LEFT JOIN sold4 ON n_regionkey = rg.k AND p_type = pt.k AND l_returnflag = fl.k AND y = yr.k",
    "us": "SELECT CAST(range AS INT) AS k, CAST(range AS INT) AS i FROM range(10)",
    "ev": "SELECT event_type AS k, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INT) AS i FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)",
    "hr": "SELECT CAST(range AS INT) AS k, CAST(range AS INT) AS i FROM range(24)",
    "seen": "SELECT user_id % 10 AS u, event_type AS e, hour(ts) AS h, sum(value) AS v FROM events GROUP BY ALL",
    "tensor_ev": "SELECT us.i AS i0, ev.i AS i1, hr.i AS i2, CAST(coalesce(v, 0) AS DOUBLE) AS val FROM us CROSS JOIN ev CROSS JOIN hr LEFT JOIN seen ON u = us.k AND e = ev.k AND h = hr.k",
    "lb": "SELECT label AS k, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS i FROM (SELECT DISTINCT label FROM embeddings WHERE label IS NOT NULL)",
    "e8": "SELECT CAST(range AS INT) AS k, CAST(range AS INT) AS i FROM range(8)",
    "parts": "SELECT label, k, embedding[k + 1] AS v FROM embeddings, range(64) t(k)",
    "met": "SELECT label, k // 8 AS a, k % 8 AS b, avg(CAST(v AS DOUBLE)) AS v FROM parts GROUP BY ALL",
    "tensor_em": "SELECT lb.i AS i0, x.i AS i1, y.i AS i2, CAST(coalesce(v, 0) AS DOUBLE) AS val FROM lb CROSS JOIN e8 x CROSS JOIN e8 y LEFT JOIN met ON label = lb.k AND a = x.k AND b = y.k",
    "sizes": "SELECT 0 AS mode, count(*) AS n FROM nk UNION ALL SELECT 1, count(*) FROM pt UNION ALL SELECT 2, count(*) FROM mo",
    "sizes4": "SELECT 0 AS mode, count(*) AS n FROM rg UNION ALL SELECT 1, count(*) FROM pt UNION ALL SELECT 2, count(*) FROM fl UNION ALL SELECT 3, count(*) FROM yr",
}
_NEEDS = {
    "tensor": ("nk", "pt", "mo", "sold"), "tensor4": ("rg", "pt", "fl", "yr", "sold4"), "tensor_ev": ("us", "ev", "hr", "seen"),
    "tensor_em": ("lb", "e8", "parts", "met"), "sizes": ("nk", "pt", "mo"), "sizes4": ("rg", "pt", "fl", "yr"),
}


def _ctes(names: list[str]) -> list[tuple[str, str]]:
    out: dict[str, str] = {}
    for name in names:
        for need in (*_NEEDS.get(name, ()), name):
            out[need] = CTE[need]
    return list(out.items())


def sql(names: list[str], body: str, extra: list[tuple[str, str]] | None = None) -> str:
    parts = ", ".join(f"{k} AS MATERIALIZED ({v})" for k, v in [*_ctes(names), *(extra or [])])
    return f"WITH {parts} {body}" if parts else body


def r(expression: str, digits: int) -> str:
    return f"round({expression}, {digits}) + 0.0"


def factor_ctes(models: str = "(0, 3)", sizes: str = "sizes") -> list[tuple[str, str]]:
    """raw: closed form; f: unit columns; w: products of norms."""
    rows = f"SELECT model_id, rank, mode, unnest(range(n)) AS row FROM (VALUES {models}) m(model_id, rank), {sizes}"
    comps = f"SELECT model_id, mode, row, unnest(range(rank)) AS comp FROM ({rows})"
    return [
        ("raw", f"SELECT CAST(model_id AS INT) AS model_id, CAST(mode AS INT) AS mode, CAST(row AS INT) AS row, CAST(comp AS INT) AS comp, 0.5 + 0.5 * sin(CAST((row + 1 + model_id) * (comp + 1) * (mode + 1) AS DOUBLE)) AS val FROM ({comps})"),
        ("norms", "SELECT model_id, mode, comp, sqrt(sum(val * val)) AS c FROM raw GROUP BY ALL"),
        ("f", "SELECT model_id, mode, row, comp, val / c AS val FROM raw JOIN norms USING (model_id, mode, comp)"),
        ("w", "SELECT model_id, comp, product(c) AS val FROM norms GROUP BY ALL"),
    ]


GRAM = ("g", "SELECT a.model_id, a.mode, a.comp AS r, b.comp AS s, sum(a.val * b.val) AS val FROM f a JOIN f b ON a.model_id = b.model_id AND a.mode = b.mode AND a.row = b.row GROUP BY ALL")


def _lin(names: list[str], sizes: list[str]) -> str:
    out, step = [], "1"
    for n, s in zip(names, sizes, strict=True):
        out.append(f"{n} * {step}")
        step += f" * {s}"
    return " + ".join(out)


_SIZE = ["(SELECT count(*) FROM nk)", "(SELECT count(*) FROM pt)", "12"]
_SIZE4 = [f"(SELECT count(*) FROM {t})" for t in ("rg", "pt", "fl", "yr")]


def _unfolded(n: int, four: bool = False) -> str:
    size = _SIZE4 if four else _SIZE
    rest = [m for m in range(len(size)) if m != n]
    return f"SELECT i{n} AS row, CAST({_lin([f'i{m}' for m in rest], [size[m] for m in rest])} AS INT) AS col, val FROM {'tensor4' if four else 'tensor'}"


def _mttkrp(n: int, modes: int = 3, table: str = "tensor") -> str:
    rest = [m for m in range(modes) if m != n]
    joins = " ".join(f"JOIN f f{m} ON f{m}.mode = {m} AND f{m}.row = i{m}" + ("" if m == rest[0] else f" AND f{m}.model_id = f{rest[0]}.model_id AND f{m}.comp = f{rest[0]}.comp") for m in rest)
    return f"SELECT f{rest[0]}.model_id AS model_id, i{n} AS row, f{rest[0]}.comp AS comp, sum({table}.val * {' * '.join(f'f{m}.val' for m in rest)}) AS val FROM {table} {joins} GROUP BY ALL"


REC = "SELECT a.model_id, a.row AS i0, b.row AS i1, c.row AS i2, sum(w.val * a.val * b.val * c.val) AS val FROM w JOIN f a ON a.model_id = w.model_id AND a.comp = w.comp AND a.mode = 0 JOIN f b ON b.model_id = w.model_id AND b.comp = w.comp AND b.mode = 1 JOIN f c ON c.model_id = w.model_id AND c.comp = w.comp AND c.mode = 2 GROUP BY ALL"
ERR = "SELECT model_id, sqrt(sum((t.val - e.val) ** 2)) AS error FROM rec e JOIN tensor t USING (i0, i1, i2) GROUP BY model_id"
CELL4 = "model_id, mode, row, comp, "


SALES, SALES4, EVENTS, EMBED = ("tensor", ("nk", "pt", "mo")), ("tensor4", ("rg", "pt", "fl", "yr")), ("tensor_ev", ("us", "ev", "hr")), ("tensor_em", ("lb", "e8", "e8"))


class Sweeps:
    """Sweeps written out as common table expressions. Factor n after a sweep is a relation (row, x0, x1, ...).

    With `jk` every relation has a column `j`, the slice of mode 0 that is left out. `model` shifts the closed-form
    start and may be an expression; `starts` gives other starts, as SELECT lists of (row, x0, ...), instead.
    """

    def __init__(self, rank: int, tensor: str, dims: tuple[str, ...], nonneg: bool = False, model: int | str = 0, jk: bool = False, starts: list[str] | None = None, prefix: str = ""):
        self.rank, self.tensor, self.dims, self.nonneg, self.jk, self.prefix = rank, tensor, dims, nonneg, jk, prefix
        self.comps = range(rank)
        self.pairs = [(a, b) for a in self.comps for b in self.comps if a <= b]
        self.out: list[tuple[str, str]] = []
        self.j, self.by, self.part = ("j, ", " GROUP BY j", "PARTITION BY j") if jk else ("", "", "")
        if jk:
            self.add("slices", f"SELECT i AS j FROM {dims[0]}")
        source = f", {prefix}slices" if jk else ""
        self.u, self.s = [], []
        for n, d in enumerate(dims):
            vals = ", ".join(f"0.5 + 0.5 * sin(CAST((i + 1 + {model}) * {c + 1} * {n + 1} AS DOUBLE)) AS x{c}" for c in self.comps)
            z = self.add(f"z{n}", f"SELECT {self.j}i AS row, {vals} FROM {d}{source}" if starts is None else f"SELECT {self.j}k.* FROM ({starts[n]}) k{source}")
            self.u.append(self.unit(f"u{n}_0", z))
            self.s.append(self.gram(f"s{n}_0", self.u[n]))
        self.lam = self.error = ""

    def add(self, name: str, text: str) -> str:
        self.out.append((self.prefix + name, text))
        return self.prefix + name

    def unit(self, name: str, of: str) -> str:
        return self.add(name, f"SELECT {self.j}row, {', '.join(f'x{c} / sqrt(sum(x{c} * x{c}) OVER ({self.part})) AS x{c}' for c in self.comps)} FROM {of}")

    def gram(self, name: str, of: str) -> str:
        return self.add(name, f"SELECT {self.j}{', '.join(f'sum(x{a} * x{b}) AS h{a}{b}' for a, b in self.pairs)} FROM {of}{self.by}")

    def _solved(self, tag: str, head: str, sources: str, h: dict) -> str:
        """Relation of the new factor before scaling, from the products g and the Hadamard product h."""
        if self.rank == 1:
            value = f"g0 / ({h[0, 0]})"
            return f"SELECT {head}, {f'greatest({value}, 0.0)' if self.nonneg else value} AS x0 FROM {sources}"
        q = self.add(f"q{tag}", f"SELECT {head}, {', '.join(f'g{c}' for c in self.comps)}, {', '.join(f'{h[x]} AS {n}' for x, n in zip(self.pairs, 'abcdef', strict=False))} FROM {sources}")
        if self.rank == 3:  # h = [[a, b, c], [b, d, e], [c, e, f]]; by cofactors
            m = {(0, 0): "(d * f - e * e)", (0, 1): "(c * e - b * f)", (0, 2): "(b * e - c * d)", (1, 1): "(a * f - c * c)", (1, 2): "(b * c - a * e)", (2, 2): "(a * d - b * b)"}
            det = f"(a * {m[0, 0]} + b * {m[0, 1]} + c * {m[0, 2]})"
            row = lambda i: " + ".join(f"g{k} * {m[min(i, k), max(i, k)]}" for k in range(3))
            return f"SELECT {self.j}row, {', '.join(f'({row(i)}) / {det} AS x{i}' for i in range(3))} FROM {q}"
        free = ["(g0 * c - g1 * b) / (a * c - b * b)", "(g1 * a - g0 * b) / (a * c - b * b)"]
        if self.nonneg:
            both, one = f"{free[0]} >= 0 AND {free[1]} >= 0", "greatest(g0, 0.0) * greatest(g0, 0.0) / a >= greatest(g1, 0.0) * greatest(g1, 0.0) / c"
            free = [f"CASE WHEN {both} THEN {free[0]} WHEN {one} THEN greatest(g0, 0.0) / a ELSE 0.0 END", f"CASE WHEN {both} THEN {free[1]} WHEN {one} THEN 0.0 ELSE greatest(g1, 0.0) / c END"]
        return f"SELECT {self.j}row, {free[0]} AS x0, {free[1]} AS x1 FROM {q}"

    def sweep(self, tag: str, first: bool = False) -> None:
        jk, comps, n_modes = self.jk, self.comps, len(self.dims)
        for n in range(n_modes):
            rest = [m for m in range(n_modes) if m != n]
            lead = self.u[rest[0]]
            joins = " ".join(f"JOIN {self.u[m]} ON {self.u[m]}.row = i{m}" + (f" AND {self.u[m]}.j = {lead}.j" if jk and m != rest[0] else "") for m in rest)
            sums = ", ".join(f"sum(val * {' * '.join(f'{self.u[m]}.x{c}' for m in rest)}) AS g{c}" for c in comps)
            g = self.add(f"g{n}_{tag}", f"SELECT {f'{lead}.j AS j, ' if jk else ''}i{n} AS row, {sums} FROM {self.tensor} {joins} GROUP BY ALL")
            h = {(a, b): " * ".join(f"{self.s[m]}.h{a}{b}" for m in rest) for a, b in self.pairs}
            sources = f"{g} " + " ".join(f"JOIN {self.s[m]} ON {self.s[m]}.j = {g}.j" if jk else f"CROSS JOIN {self.s[m]}" for m in rest)
            y = self._solved(f"{n}_{tag}", (f"{g}.j AS j, " if jk else "") + f"{g}.row AS row", sources, h)
            if jk and n == 0:
                y = self.add(f"y{n}_{tag}a", y)
                y = f"SELECT j, row, {', '.join(f'CASE WHEN row = j THEN 0.0 ELSE x{c} END AS x{c}' for c in comps)} FROM {y}"
            y = self.add(f"y{n}_{tag}", y)
            size = "sqrt(sum(x{c} * x{c})) AS l{c}" if first else "arg_max(x{c}, (abs(x{c}), -row)) AS l{c}"
            self.lam = self.add(f"l{n}_{tag}", f"SELECT {self.j}{', '.join(size.format(c=c) for c in comps)} FROM {y}{self.by}")
            scaled = ", ".join(f"CASE WHEN l{c} = 0 THEN x{c} ELSE x{c} / l{c} END AS x{c}" for c in comps)
            self.u[n] = self.add(f"u{n}_{tag}", f"SELECT {self.j}row, {scaled} FROM {y} " + (f"JOIN {self.lam} USING (j)" if jk else f"CROSS JOIN {self.lam}"))
            self.s[n] = self.gram(f"s{n}_{tag}", self.u[n])
        own = " + ".join(f"{'1' if a == b else '2'} * l{a} * l{b} * {' * '.join(f'{x}.h{a}{b}' for x in self.s)}" for a, b in self.pairs)
        cross = " + ".join(f"l{c} * x{c} * g{c}" for c in comps)
        x_norm = f"(SELECT sum(val * val) FROM {self.tensor})"
        if jk:
            norm2 = f"({x_norm} - (SELECT sum(val * val) FROM {self.tensor} WHERE i0 = k.j))"
            error = f"SELECT k.j AS j, sqrt(greatest({norm2} + k.own - 2 * c.crossed, 0)) AS error FROM (SELECT {self.lam}.j AS j, {own} AS own FROM {self.lam} {' '.join(f'JOIN {x} ON {x}.j = {self.lam}.j' for x in self.s)}) k JOIN (SELECT u.j AS j, sum({cross}) AS crossed FROM {self.u[-1]} u JOIN {g} g ON g.j = u.j AND g.row = u.row JOIN {self.lam} l ON l.j = u.j GROUP BY u.j) c ON c.j = k.j"
        else:
            error = f"SELECT sqrt(greatest({x_norm} + (SELECT {own} FROM {self.lam} {' '.join(f'CROSS JOIN {x}' for x in self.s)}) - 2 * (SELECT sum({cross}) FROM {self.u[-1]} JOIN {g} USING (row) CROSS JOIN {self.lam}), 0)) AS error"
        self.error = self.add(f"e_{tag}", error)

    def run(self, sweeps: int) -> Sweeps:
        for t in range(1, sweeps + 1):
            self.sweep(str(t), t == 1)
        return self

    def moved(self, tag: str, before: list[str], step: str, weights: tuple[str, str] | None) -> list[str]:
        """Factors extrapolated from those before; with weights (now, before) both are denormalised first."""
        out = []
        for n in range(len(self.dims)):
            now, then = ([f"x{c} * l{c}" if weights and n == 0 else f"x{c}" for c in self.comps] for _ in range(2))
            a = f"(SELECT row, {', '.join(f'{v} AS x{c}' for c, v in enumerate(now))} FROM {self.u[n]}{f' CROSS JOIN {weights[0]}' if weights and n == 0 else ''})"
            p = f"(SELECT row, {', '.join(f'{v} AS x{c}' for c, v in enumerate(then))} FROM {before[n]}{f' CROSS JOIN {weights[1]}' if weights and n == 0 else ''})"
            out.append(self.add(f"mv{n}_{tag}", f"SELECT a.row, {', '.join(f'a.x{c} + {step} * (a.x{c} - p.x{c}) AS x{c}' for c in self.comps)} FROM {a} a JOIN {p} p ON a.row = p.row"))
        return out

    def search_checked(self, tag: str, before: list[str], step: str) -> None:
        """Take the extrapolated factors if the explicit error with the present weights is less."""
        moved = self.moved(tag, before, step, None)
        joins = " ".join(f"JOIN {m} m{n} ON m{n}.row = i{n}" for n, m in enumerate(moved))
        model = " + ".join(f"l{c} * {' * '.join(f'm{n}.x{c}' for n in range(len(moved)))}" for c in self.comps)
        better = self.add(f"ok_{tag}", f"SELECT (SELECT sqrt(sum((val - ({model})) ** 2)) FROM {self.tensor} {joins} CROSS JOIN {self.lam}) < (SELECT error FROM {self.error}) AS ok")
        for n, m in enumerate(moved):
            scaled = f"(SELECT row, {', '.join(f'x{c} * l{c} AS x{c}' for c in self.comps)} FROM {m} CROSS JOIN {self.lam})" if n == 0 else m
            unit = self.unit(f"mu{n}_{tag}", scaled)
            self.u[n] = self.add(f"v{n}_{tag}", f"SELECT a.row, {', '.join(f'CASE WHEN ok THEN m.x{c} ELSE a.x{c} END AS x{c}' for c in self.comps)} FROM {self.u[n]} a JOIN {unit} m ON a.row = m.row CROSS JOIN {better}")
            self.s[n] = self.gram(f"vs{n}_{tag}", self.u[n])


def als_ctes(rank: int, sweeps: int, tensor: str = "tensor", dims: tuple[str, ...] = ("nk", "pt", "mo"), nonneg: bool = False) -> list[tuple[str, str]]:
    return Sweeps(rank, tensor, dims, nonneg).run(sweeps).out


def als_history(tensor: str, dims: tuple[str, ...], rank: int, sweeps: int, nonneg: bool = False) -> str:
    rows = " UNION ALL ".join(f"SELECT {t} AS iter, error FROM e_{t}" for t in range(1, sweeps + 1))
    body = f"SELECT CAST(iter AS INT) AS iter, {r('error', 4)} AS error, {r(f'1 - error / sqrt((SELECT sum(val * val) FROM {tensor}))', 4)} AS fit FROM ({rows})"
    return sql([tensor], body, als_ctes(rank, sweeps, tensor, dims, nonneg))


def _several(ranks: dict[int, int] | None = None, sweeps: int = 2, digits: int = 4) -> str:
    """Errors of models {id: rank} after these sweeps."""
    ranks = ranks or {0: 1, 1: 2, 2: 2}
    extra, rows = [], []
    for model, rank in ranks.items():
        one = Sweeps(rank, *SALES, model=model, prefix=f"m{model}").run(sweeps)
        extra += one.out
        rows.append(f"SELECT {model} AS model_id, {rank} AS components, {sweeps} AS iters, error FROM {one.error}")
    body = f"SELECT CAST(model_id AS INT) AS model_id, CAST(components AS INT) AS components, CAST(iters AS INT) AS iters, {r('error', digits)} AS error, {r('1 - error / sqrt((SELECT sum(val * val) FROM tensor))', digits)} AS fit FROM ({' UNION ALL '.join(rows)})"
    return sql(["tensor"], body, extra)


def _hybrid(ranks: dict[int, int], sweeps: int) -> str:
    return f"SELECT components, CAST(arg_min(model_id, (error, model_id)) AS INT) AS model_id, min(error) AS error FROM ({_several(ranks, sweeps)}) GROUP BY components"


def _searched(checked: bool) -> str:
    """Four sweeps with line search at every second one."""
    if checked:
        one = Sweeps(2, *SALES)
        errors = []
        for t in range(1, 5):
            before = list(one.u)
            one.sweep(str(t), t == 1)
            errors.append(f"SELECT {t} AS iter, error FROM {one.error}")
            if t % 2 == 0:
                one.search_checked(str(t), before, f"cbrt({t}.0)")
        return sql(["tensor"], f"SELECT CAST(iter AS INT) AS iter, {r('error', 4)} AS error FROM ({' UNION ALL '.join(errors)})", one.out)
    # unchecked: extrapolated after sweep 2; if sweep 3 ends above sweep 2, back to the state after it, then two sweeps
    one = Sweeps(2, *SALES)
    one.sweep("1", True)
    before, lam = list(one.u), one.lam
    one.sweep("2")
    error, state = one.error, (list(one.u), list(one.s))
    moved = one.moved("2", before, "cbrt(2.0)", (one.lam, lam))
    one.u = [one.unit(f"v{n}", m) for n, m in enumerate(moved)]
    one.s = [one.gram(f"vs{n}", u) for n, u in enumerate(one.u)]
    one.sweep("3")
    third = one.error
    one.sweep("4")
    kept = one.error
    one.u, one.s = state
    one.sweep("3b")
    one.sweep("4b")
    back = f"(SELECT error FROM {error}) < (SELECT error FROM {third})"
    return sql(["tensor"], f"SELECT CAST(4 AS INT) AS iters, {r(f'CASE WHEN {back} THEN (SELECT error FROM {one.error}) ELSE (SELECT error FROM {kept}) END', 4)} AS error, CAST(1 AS INT) AS extrapolated, CAST(CASE WHEN {back} THEN 1 ELSE 0 END AS INT) AS reverted", one.out)


def _jackknife(what: str) -> str:
    """Replicas of a reference of rank 1 after two sweeps each."""
    ref = Sweeps(1, *EVENTS, prefix="r").run(2)
    start = [f"SELECT row, x0 * l0 AS x0 FROM {ref.u[0]} CROSS JOIN {ref.lam}", *(f"SELECT row, x0 FROM {u}" for u in ref.u[1:])]
    one = Sweeps(1, *EVENTS, jk=True, starts=start).run(2)
    extra = [*ref.out, *one.out]
    if what == "error":
        return sql(["tensor_ev"], f"SELECT j AS jk_fiber, {r('error', 4)} AS error FROM {one.error}", extra)
    # folded, scaled to unit columns, without the row that was left out; then the deviation over replicas
    rows = [f"SELECT u.j, {n} AS mode, row, x0{' * l0' if n == 0 else ''} AS x FROM {u} u" + (f" JOIN {one.lam} l ON l.j = u.j" if n == 0 else "") for n, u in enumerate(one.u)]
    extra.append(("scaled", f"SELECT j, mode, row, x / sqrt(sum(x * x) OVER (PARTITION BY j, mode)) AS x FROM ({' UNION ALL '.join(rows)})"))
    return sql(["tensor_ev"], f"SELECT CAST(mode AS INT) AS mode, row, CAST(0 AS INT) AS comp, {r('stddev_samp(x)', 6)} AS std FROM scaled WHERE NOT (mode = 0 AND row = j) GROUP BY mode, row", extra)


def _both() -> str:
    """A reference model (id 0) and replicas (id 1 + slice) in one queue, each from its own closed form."""
    ref = Sweeps(1, *EVENTS, prefix="r").run(2)
    one = Sweeps(1, *EVENTS, jk=True, model="j + 1").run(2)
    return sql(["tensor_ev"], f"SELECT CAST(0 AS INT) AS model_id, {r('error', 4)} AS error FROM {ref.error} UNION ALL SELECT CAST(j + 1 AS INT), {r('error', 4)} FROM {one.error}", [*ref.out, *one.out])


def _cells() -> tuple[str, str]:
    return ("cells", "SELECT CAST(range AS INT) AS cell, CASE WHEN range % 7 < 3 OR range = 12 THEN CAST(range // 7 AS INT) END AS owner FROM range(24)")


HIST = ("h", "SELECT o_orderpriority AS method, CAST(month(o_orderdate) AS INT) AS iter, CAST(count(*) AS INT) AS cols, sum(o_totalprice) AS flops, avg(o_totalprice) AS total, min(o_totalprice) AS defrag FROM orders GROUP BY ALL")
F3 = factor_ctes()
F32 = factor_ctes("(0, 3), (1, 2)")

ORACLES = {
    "tensor_from_table": sql(["tensor"], f"SELECT i0, i1, i2, {r('val', 2)} AS val FROM tensor"),
    "tensor_4d_from_table": sql(["tensor4"], f"SELECT i0, i1, i2, i3, {r('val', 2)} AS val FROM tensor4"),
    "tensor_events": sql(["tensor_ev"], f"SELECT i0, i1, i2, {r('val', 4)} AS val FROM tensor_ev"),
    "tensor_embeddings": sql(["tensor_em"], f"SELECT i0, i1, i2, {r('val', 6)} AS val FROM tensor_em"),
    "tensor_norm": sql(["tensor"], f"SELECT {r('sqrt(sum(val * val))', 4)} AS norm FROM tensor"),
    "tensor_min": sql(["tensor"], f"SELECT {r('min(val)', 4)} AS min FROM tensor"),
    "tensor_masked_max": sql(["tensor"], f"SELECT {r('val', 4)} AS val, CAST({_lin(['i0', 'i1', 'i2'], _SIZE)} AS INT) AS at FROM tensor WHERE i2 % 2 = 0 ORDER BY tensor.val DESC, 2 LIMIT 1"),
    "tensor_fill": "SELECT CAST(a.range AS INT) AS i0, CAST(b.range AS INT) AS i1, CAST(c.range AS INT) AS i2, CAST(a.range + 10 * b.range + 100 * c.range AS DOUBLE) AS val FROM range(4) a, range(3) b, range(5) c",
    "tensor_element": sql(["tensor"], f"SELECT {r('val', 4)} AS val FROM tensor WHERE i0 = 3 AND i1 = 2 AND i2 = 5"),
    "tensor_mode_string": sql(["nk", "pt", "rg", "fl", "yr"], f"SELECT concat_ws('-', {', '.join(_SIZE)}) AS sales, concat_ws('-', {', '.join(_SIZE4)}) AS sales4"),
    **{f"unfold_mode{n}": sql(["tensor"], f"SELECT row, col, {r('val', 2)} AS val FROM ({_unfolded(n)})") for n in range(3)},
    "unfold_4d_mode2": sql(["tensor4"], f"SELECT row, col, {r('val', 2)} AS val FROM ({_unfolded(2, True)})"),
    "matrix_transpose": sql(["tensor"], f"SELECT col AS row, row AS col, {r('val', 2)} AS val FROM ({_unfolded(1)})"),
    "matrix_resize": sql(["tensor"], f"SELECT row, col, {r('val', 2)} AS val FROM ({_unfolded(0)}) WHERE row < 10 AND col < 20"),
    "matrix_one_norm": sql(["tensor"], f"SELECT {r('max(s)', 4)} AS one_norm FROM (SELECT col, sum(abs(val)) AS s FROM ({_unfolded(0)}) GROUP BY col)"),
    "matrix_hadamard": sql(["tensor"], f"SELECT row, col, {r('val * (val + 1)', 2)} AS val FROM ({_unfolded(0)})"),
    "factor_init": sql(["sizes"], f"SELECT {CELL4}{r('val', 6)} AS val FROM raw", F32),
    "factor_normalize": sql(["sizes"], f"SELECT {CELL4}{r('val', 6)} AS val FROM f", F32),
    "factor_weights": sql(["sizes"], f"SELECT model_id, comp, {r('val', 6)} AS val FROM w", F32),
    "factor_normalize_maxabs": sql(["sizes"], f"SELECT {CELL4}{r('val / arg_max(val, (abs(val), -row)) OVER (PARTITION BY comp)', 6)} AS val FROM f WHERE mode = 0", F3),
    "factor_normalize_first": sql(["sizes"], f"SELECT {CELL4}{r('val', 6)} AS val FROM f WHERE mode = 1", F3),
    "factor_denormalize": sql(["sizes"], f"SELECT {CELL4}{r('CASE WHEN mode = 0 THEN f.val * w.val ELSE f.val END', 6)} AS val FROM f JOIN w USING (model_id, comp)", F3),
    "factor_extrapolate": sql(["sizes"], f"SELECT {CELL4}{r('val + 1.5 * (val - val * 0.9)', 6)} AS val FROM f", F3),
    "gramian": sql(["sizes"], f"SELECT model_id, mode, r, s, {r('val', 6)} AS val FROM g", [*F32, GRAM]),
    "hadamard_all": sql(["sizes"], f"SELECT model_id, r, s, {r('product(val)', 6)} AS val FROM g GROUP BY model_id, r, s", [*F3, GRAM]),
    "hadamard_but_one": sql(["sizes"], f"SELECT model_id, r, s, {r('product(val)', 6)} AS val FROM g WHERE mode <> 1 GROUP BY model_id, r, s", [*F3, GRAM]),
    "khatri_rao_pair": sql(["sizes"], f"SELECT a.model_id, CAST(a.row * (SELECT count(*) FROM pt) + b.row AS INT) AS row, a.comp, {r('a.val * b.val', 6)} AS val FROM f a JOIN f b ON a.comp = b.comp AND a.mode = 2 AND b.mode = 1", F3),
    "khatri_rao_4d": sql(["sizes4"], f"SELECT a.model_id, CAST({_lin(['a.row', 'b.row', 'c.row'], [_SIZE4[0], _SIZE4[2], _SIZE4[3]])} AS INT) AS row, a.comp, {r('a.val * b.val * c.val', 6)} AS val FROM f a JOIN f b ON a.comp = b.comp AND a.mode = 0 AND b.mode = 2 JOIN f c ON a.comp = c.comp AND c.mode = 3", factor_ctes(sizes="sizes4")),
    **{name.format(n=n): sql(["tensor", "sizes"], f"SELECT model_id, row, comp, {r('val', 3)} AS val FROM ({_mttkrp(n)})", F3) for n in range(3) for name in ("mttkrp_mode{n}", "mttkrp_twostep0_mode{n}", "mttkrp_twostep1_mode{n}", "mttkrp_auto_mode{n}")},
    "mttkrp_4d": sql(["tensor4", "sizes4"], f"SELECT model_id, row, comp, {r('val', 3)} AS val FROM ({_mttkrp(2, 4, 'tensor4')})", factor_ctes(sizes="sizes4")),
    "mttkrp_multi_model": sql(["tensor", "sizes"], f"SELECT model_id, row, comp, {r('val', 3)} AS val FROM ({_mttkrp(0)})", factor_ctes("(0, 3), (1, 1), (2, 2)")),
    "reconstruct": sql(["sizes"], f"SELECT model_id, i0, i1, i2, {r('val', 6)} AS val FROM ({REC})", F3),
    "residual": sql(["tensor", "sizes"], f"SELECT i0, i1, i2, {r('t.val - e.val', 3)} AS val FROM tensor t JOIN ({REC}) e USING (i0, i1, i2)", F3),
    "error_fast": sql(["tensor", "sizes"], f"SELECT model_id, {r('error', 3)} AS error FROM ({ERR})", [*F32, ("rec", REC)]),
    "error_explicit": sql(["tensor", "sizes"], f"SELECT model_id, {r('error', 3)} AS error FROM ({ERR})", [*F32, ("rec", REC)]),
    "fit": sql(["tensor", "sizes"], f"SELECT model_id, {r('1 - error / (SELECT sqrt(sum(val * val)) FROM tensor)', 6)} AS fit FROM ({ERR})", [*F32, ("rec", REC)]),
    "jk_norms": sql(["tensor"], f"SELECT i0 AS fiber, {r('sqrt((SELECT sum(val * val) FROM tensor) - sum(val * val))', 4)} AS norm FROM tensor GROUP BY i0"),
    "jk_slice_removed": sql(["tensor"], f"SELECT CAST(i0 - CASE WHEN i0 > 4 THEN 1 ELSE 0 END AS INT) AS i0, i1, i2, {r('val', 2)} AS val FROM tensor WHERE i0 <> 4"),
    "jk_replicas": sql(["nk"], "SELECT CAST(model_id AS INT) AS model_id, CAST(0 AS INT) AS jk_mode, i AS jk_fiber, CAST(model_id * (SELECT count(*) FROM nk) + i AS INT) AS replica_id FROM (VALUES (0), (3)) m(model_id), nk"),
    "jk_mask": sql(["sizes"], f"SELECT {CELL4}{r('CASE WHEN mode = 0 AND row = 4 THEN 0.0 ELSE val END', 6)} AS val FROM f", F3),
    "jk_mask_null": sql(["sizes"], f"SELECT {CELL4}{r('CASE WHEN mode = 0 AND row = 4 THEN NULL ELSE val END', 6)} AS val FROM f", F3),
    "jk_to_regular": sql(["sizes"], f"SELECT model_id, mode, CAST(row - CASE WHEN mode = 0 AND row > 4 THEN 1 ELSE 0 END AS INT) AS row, comp, {r('val', 6)} AS val FROM f WHERE NOT (mode = 0 AND row = 4)", F3),
    "jk_concat": sql(["sizes"], f"SELECT mode, row, CAST(CASE model_id WHEN 7 THEN 0 ELSE 2 END + comp AS INT) AS comp, {r('val', 6)} AS val FROM f", factor_ctes("(4, 2), (7, 2)")),
    "jk_std": sql(["sizes"], f"SELECT mode, row, comp, {r('stddev_samp(val)', 8)} AS std FROM f GROUP BY mode, row, comp", factor_ctes("(0, 2), (1, 2), (2, 2)")),
    "jk_alignment_scores": sql(["sizes"], f"SELECT b.model_id, a.comp AS r, b.comp AS s, {r('sum(a.val * b.val)', 6)} AS val FROM f a JOIN f b ON a.mode = b.mode AND a.row = b.row AND a.model_id = 0 AND b.model_id = 1 AND a.mode <> 0 GROUP BY ALL", factor_ctes("(0, 3), (1, 3)")),
    "als_rank1": als_history(*SALES, 1, 3),
    "als_rank2": als_history(*SALES, 2, 3),
    "als_slabs_rank2": als_history(*SALES, 2, 3),
    "als_twostep0_rank2": als_history(*SALES, 2, 3),
    "als_rank2_factors": sql(["tensor"], f"SELECT CAST(mode AS INT) AS mode, CAST(row AS INT) AS row, CAST(comp AS INT) AS comp, {r('val', 5)} AS val FROM (" + " UNION ALL ".join(f"SELECT {n} AS mode, row, {c} AS comp, x{c} AS val FROM u{n}_3" for n in range(3) for c in range(2)) + ")", als_ctes(2, 3)),
    "als_rank2_weights": sql(["tensor"], f"SELECT CAST(0 AS INT) AS comp, {r('l0', 3)} AS val FROM l2_3 UNION ALL SELECT CAST(1 AS INT), {r('l1', 3)} FROM l2_3", als_ctes(2, 3)),
    "als_nonneg_rank2": als_history(*SALES, 2, 3, True),
    "als_4d_rank1": als_history(*SALES4, 1, 3),
    "als_4d_rank2": als_history(*SALES4, 2, 2),
    "als_events_rank2": als_history(*EVENTS, 2, 3),
    "als_embeddings_rank2": als_history(*EMBED, 2, 3),
    "als_many_models": _several(),
    "concurrent_models": _several(),
    "hybrid_best_per_rank": sql(["tensor", "sizes"], f"SELECT CAST(components AS INT) AS components, CAST(arg_min(model_id, (error, model_id)) AS INT) AS model_id, {r('min(error)', 3)} AS error FROM ({ERR}) JOIN (SELECT model_id, count(*) AS components FROM w GROUP BY model_id) USING (model_id) GROUP BY components", [*factor_ctes("(0, 1), (1, 1), (2, 2), (3, 2), (4, 3), (5, 3)"), ("rec", REC)]),
    "jk_mask_equals_deletion": sql(["us", "ev", "hr"], "SELECT CAST((SELECT count(*) FROM us) * 2 * ((SELECT count(*) FROM us) - 1 + (SELECT count(*) FROM ev) + (SELECT count(*) FROM hr)) AS INT) AS n, true AS equal"),
    "lut_lookup": "WITH lut AS (SELECT * FROM (VALUES (0, 1, 2), (0, 4, 0), (0, 16, 1), (1, 2, 1), (1, 8, 0)) t(mode, rank, method)), w AS (SELECT CAST(range AS INT) AS active FROM range(1, 21)) SELECT CAST(m.mode AS INT) AS mode, active, CAST(coalesce((SELECT method FROM lut l WHERE l.mode = m.mode AND l.rank >= active ORDER BY l.rank LIMIT 1), (SELECT method FROM lut l WHERE l.mode = m.mode ORDER BY l.rank DESC LIMIT 1)) AS INT) AS method FROM w, (VALUES (0), (1)) m(mode)",
    "lut_best_method": "WITH b AS (SELECT CAST(range % 3 AS INT) AS mode, CAST(range // 3 % 3 AS INT) AS method, CAST(range // 9 + 1 AS INT) AS rank FROM range(45)) SELECT mode, rank, CAST(arg_max(method, (rank * 1000.0 / (1.0 + (method * 7 + rank * 5 + mode * 3) % 11), -method)) AS INT) AS method FROM b GROUP BY mode, rank",
    "flops_model": sql(["nk", "pt"], f"SELECT CAST(m AS INT) AS mode, CAST(k AS INT) AS rank, method, CAST(CASE method WHEN 'mttkrp' THEN 2 * t * k + t // s[m + 1] * k ELSE 2 * t * k + 2 * s[m + 1] * s[CASE WHEN (method = 'twostep0') THEN [2, 1, 2][m + 1] ELSE [3, 3, 1][m + 1] END] * k END AS BIGINT) AS flops FROM (SELECT [{', '.join(_SIZE)}] AS s, {' * '.join(_SIZE)} AS t), range(3) a(m), (VALUES (1), (5)) b(k), (VALUES ('mttkrp'), ('twostep0'), ('twostep1')) c(method)"),
    "buffer_first_fit": sql([], "SELECT CAST(min(start) AS INT) AS start FROM (SELECT min(cell) AS start, count(*) AS n FROM (SELECT cell, cell - row_number() OVER (ORDER BY cell) AS island FROM cells WHERE owner IS NULL) GROUP BY island) WHERE n >= 4", [_cells()]),
    "buffer_compress": sql([], "SELECT owner, cell, CAST(cell - gaps AS INT) AS new_cell FROM (SELECT *, sum(CASE WHEN owner IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY cell) AS gaps FROM cells) WHERE owner IS NOT NULL", [_cells()]),
    "jk_als_rank1": _jackknife("error"),
    "jk_fit_std": _jackknife("std"),
    "queue_of_both": _both(),
    "concurrent_als": _several({0: 1, 1: 1, 2: 2, 3: 2, 4: 3, 5: 3}, 3, 2),
    "als_line_search": _searched(True),
    "als_line_search_unchecked": _searched(False),
    "hybrid_fit": _hybrid({0: 1, 1: 1, 2: 2, 3: 2}, 2),
    "report_als": sql([], f"SELECT method, CAST(count(*) AS INT) AS iters, {r('min(total)', 2)} AS total, {r('min(defrag)', 2)} AS defrag FROM h GROUP BY method", [HIST]),
    "report_cumflops": sql([], f"SELECT method, iter, {r('sum(flops) OVER (PARTITION BY method ORDER BY iter)', 1)} AS cum_flops FROM h", [HIST]),
    "report_rollup": sql([], f"SELECT method, {r('sum(total)', 2)} AS total, CAST(sum(cols) AS INT) AS cols, {r('sum(flops * iter)', 2)} AS flops, CAST(max(iter) AS INT) AS iters FROM h GROUP BY method", [HIST]),
    "report_defrag_ratio": sql([], f"SELECT {r('avg(defrag / total)', 8)} AS mean, {r('median(defrag / total)', 8)} AS median, {r('max(defrag / total)', 8)} AS max, {r('min(defrag / total)', 8)} AS min FROM h", [HIST]),
    "report_speedup": sql([], f"SELECT iter, {r('a / b', 8)} AS speed_up FROM (SELECT iter, sum(total) AS a FROM h WHERE method LIKE '1%' GROUP BY iter) JOIN (SELECT iter, sum(total) AS b FROM h WHERE method NOT LIKE '1%' GROUP BY iter) USING (iter)", [HIST]),
    "report_pivot": sql([], f"SELECT method, {', '.join(r(f'max(CASE WHEN iter = {k} THEN total END)', 2) + f' AS r{k}' for k in (1, 2, 3))}, {r('sum(total)', 2)} AS total FROM h WHERE iter <= 3 GROUP BY method", [HIST]),
    "report_fit_difference": sql([], f"SELECT CAST(substr(method, 1, 1) AS INT) AS model_id, iter, {r('total / 1e6', 6)} AS fit, {r('abs(coalesce(lag(total / 1e6) OVER (PARTITION BY method ORDER BY iter), 0) - total / 1e6)', 6)} AS fit_diff FROM h", [HIST]),
}
ORACLES |= {
    "report_timing_stats": sql([], f"SELECT method, {r('min(total)', 4)} AS min, {r('max(total)', 4)} AS max, {r('avg(total)', 4)} AS mean, {r('median(total)', 4)} AS median, {r('stddev_pop(total)', 4)} AS std FROM h GROUP BY method", [HIST]),
    "report_unpivot": sql([], f"SELECT method, 'r' || iter AS measure, {r('total', 2)} AS value FROM h WHERE iter <= 3 UNION ALL SELECT method, 'total', {r('sum(total)', 2)} FROM h WHERE iter <= 3 GROUP BY method", [HIST]),
    "report_efficiency": f"WITH b AS (SELECT range % 3 AS mode, range // 3 % 3 AS method, range // 9 + 1 AS rank FROM range(45)), t AS (SELECT mode, rank, rank * 1000.0 AS flops, min(1.0 + (method * 7 + rank * 5 + mode * 3) % 11) AS time FROM b GROUP BY mode, rank) SELECT CAST(rank AS INT) AS rank, {r('CAST(sum(flops) / sum(time) / 1e4 AS DOUBLE)', 8)} AS efficiency FROM t GROUP BY rank",
    "buffer_leftmost": sql([], "SELECT arg_min(owner, cell) AS owner FROM cells WHERE owner IS NOT NULL", [_cells()]),
    "report_models": f"SELECT model_id AS \"KTENSOR_ID\", components AS \"KTENSOR_RANK\", error AS \"ERROR\", iters AS \"ITERS\" FROM ({_several()})",
}
_SPARSE = "SELECT model_id, sqrt(sum((CASE WHEN (i0 + 2 * i1 + 3 * i2) % 5 = 0 THEN t.val ELSE 0 END - e.val) ** 2)) AS error FROM rec e JOIN tensor t USING (i0, i1, i2) GROUP BY model_id"
_FLOPS = "(SELECT sum(2 * t + CASE WHEN t // s[n + 1] < s[n + 1] * least(s[(n + 1) % 3 + 1], s[(n + 2) % 3 + 1]) THEN t // s[n + 1] ELSE 2 * s[n + 1] * least(s[(n + 1) % 3 + 1], s[(n + 2) % 3 + 1]) END) FROM range(3) k(n), (SELECT [{sizes}] AS s, {cells} AS t))".format(sizes=", ".join(_SIZE), cells=" * ".join(_SIZE))
_LABEL = f"concat_ws('-', {', '.join(_SIZE)})"
ORACLES |= {
    "error_fast_sparse": sql(["tensor", "sizes"], f"SELECT model_id, {r('error', 3)} AS error FROM ({_SPARSE})", [*F32, ("rec", REC)]),
    "error_explicit_sparse": sql(["tensor", "sizes"], f"SELECT model_id, {r('error', 3)} AS error FROM ({_SPARSE})", [*F32, ("rec", REC)]),
    "set_factor": sql(["sizes"], f"SELECT {CELL4}{r('CASE WHEN model_id = 1 AND mode = 1 THEN 2 * val ELSE val END', 6)} AS val FROM f", factor_ctes("(0, 2), (1, 2)")),
    "set_weights": sql(["sizes"], f"SELECT model_id, comp, {r('CASE WHEN model_id = 0 THEN 1.0 ELSE val END', 6)} AS val FROM w", factor_ctes("(0, 2), (1, 2)")),
    "matrix_fill": "SELECT CAST(a.range AS INT) AS row, CAST(b.range AS INT) AS col, CAST(a.range + 10 * b.range AS DOUBLE) AS val FROM range(4) a, range(3) b",
    "component_list": "SELECT CAST(range AS INT) AS model_id, CAST(2 + range // 3 AS INT) AS components FROM range(9)",
    "report_concurrent": sql(["nk", "pt", "mo"], f"SELECT {_LABEL} AS \"TENSOR_MODES\", CAST(4 AS INT) AS \"BUFFER_SIZE\", CAST(6 AS INT) AS \"N_KTENSORS\", CAST(12 AS INT) AS \"KTENSOR_COMP_SUM\", CAST(range AS INT) AS \"ITER\", CAST(cols AS INT) AS \"COLS\", CAST(models AS INT) AS \"MODELS\", CAST(cols * {_FLOPS} AS BIGINT) AS \"FLOPS\" FROM range(1, 13) JOIN (VALUES (0, 4, 3), (1, 2, 1), (2, 3, 1), (3, 3, 1)) v(part, cols, models) ON (range - 1) // 3 = part"),
    "report_run": sql(["nk", "pt", "mo"], f"SELECT {_LABEL} AS \"TENSOR_MODES\", CAST(range AS INT) AS \"KTENSOR_ID\", CAST(1 + range // 2 AS INT) AS \"KTENSOR_COMP\", 'unconstrained' AS \"UPDATE_METHOD\", CAST(3 AS INT) AS \"MAX_ITERS\", CAST(3 AS INT) AS \"ITER\", CAST((1 + range // 2) * {_FLOPS} AS BIGINT) AS \"FLOPS\" FROM range(6)"),
}


def _evicted() -> str:
    """Models of ranks 1, 2 and 2 that leave after one, two and three sweeps."""
    made = [Sweeps(rank, *SALES, model=model, prefix=f"m{model}").run(sweeps) for model, rank, sweeps in ((0, 1, 1), (1, 2, 2), (2, 2, 3))]
    rows = [f"SELECT {k} AS model_id, {t} AS iters, error FROM {one.error}" for k, (one, t) in enumerate(zip(made, (1, 2, 3), strict=True))]
    return sql(["tensor"], f"SELECT CAST(model_id AS INT) AS model_id, CAST(iters AS INT) AS iters, {r('error', 4)} AS error FROM ({' UNION ALL '.join(rows)})", [x for one in made for x in one.out])


def _tolerated() -> str:
    """Rank 1 from two starts: the first sweep at which the fit changes by less than 0.01, of four written out."""
    made, rows = [], []
    for model in (0, 1):
        one = Sweeps(1, *SALES, model=model, prefix=f"m{model}")
        for t in range(1, 5):
            one.sweep(str(t), t == 1)
            rows.append(f"SELECT {model} AS model_id, {t} AS iters, error FROM {one.error}")
        made += one.out
    fits = "SELECT *, 1 - error / (SELECT sqrt(sum(val * val)) FROM tensor) AS fit FROM h"
    steps = f"SELECT *, abs(fit - lag(fit, 1, 0.0) OVER (PARTITION BY model_id ORDER BY iters)) AS moved FROM ({fits})"
    return sql(["tensor"], f"SELECT CAST(model_id AS INT) AS model_id, CAST(min(iters) AS INT) AS iters, 'converged' AS status, {r('arg_min(error, iters)', 4)} AS error FROM ({steps}) WHERE moved < 0.01 GROUP BY model_id", [*made, ("h", " UNION ALL ".join(rows))])


ORACLES |= {
    "report_csv": ORACLES["report_run"],
    "lut_files": ORACLES["lut_best_method"],
    "tensor_text": ORACLES["tensor_from_table"],
    "table_function": ORACLES["als_rank2_factors"],
    "als_evict_first": _evicted(),
    "als_to_tolerance": _tolerated(),
    "jk_align": sql(["sizes"], f"SELECT mode, row, comp, {r('val', 6)} AS val FROM f UNION ALL SELECT CAST(-1 AS INT), CAST(0 AS INT), CAST(range AS INT), 5.0 + range FROM range(3)", F3),
}
