"""SQL counterparts of the registered queries, written from the definitions and not from the library."""

from __future__ import annotations

from workload.queries import (
    BOUNDED,
    CLASS_SWARM,
    FREE,
    PARTICLES,
    PERSONAL,
    PUBLISHED,
    SWEEP_ITERATIONS,
    SWEEP_PARTICLES,
    SWEEP_ROWS,
)

D, H = 14, 26  # demand: inputs, hidden neurons
CD, CH = 64, 121  # vectors
SMALL_H = 3
SMALL_W = SMALL_H * (D + 1)


def lattice(p, k, g, t=0, seed=0) -> str:
    return (
        f"((((CAST({p} AS BIGINT) * 7919 + CAST({k} AS BIGINT) * 104729 + CAST({g} AS BIGINT) * 15485863"
        f" + CAST({t} AS BIGINT) * 32452843 + {seed * 1299709}) * 48271) % 2147483647) / 2147483647e0)"
    )


def drawn(size, limit, p, g, first=0, t=0, seed=0) -> str:
    u = lattice(p, "k", g, t, seed)
    scaled = f"CAST({float(limit)!r} AS DOUBLE) * (2e0 * {u} - 1e0)"
    return f"list_transform(range({first}, {first + size}), lambda k: {scaled})"


def r6(x) -> str:
    return f"round({x}, 6) + 0e0"


def act(x, kind) -> str:
    return {
        "identity": x,
        "tanh": f"tanh({x})",
        "relu": f"greatest(0e0, {x})",
        "sigmoid": f"1e0 / (1e0 + exp(-({x})))",
    }[kind]


def net(x, w, d, h, hidden, output="identity") -> str:
    cell = act(f"list_dot_product({x}, {w}[j * {d} + 1 : (j + 1) * {d}])", hidden)
    total = f"list_sum(list_transform(range(0, {h}), lambda j: {cell} * {w}[{d * h} + j + 1]))"
    return act(total, output)


E = f"""e AS MATERIALIZED (
  SELECT event_id AS row_id, CAST(hour(ts) AS INTEGER) AS grp,
         list_concat(list_concat(
           list_transform(range(1, 8), lambda d: CASE WHEN d = isodow(ts) THEN 1e0 ELSE 0e0 END),
           list_transform(range(0, 6), lambda d: CASE WHEN d = minute(ts) // 10 THEN 1e0 ELSE 0e0 END)),
           [CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 100e0]) AS x,
         value / 100e0 AS y
  FROM events)"""
C = """c AS MATERIALIZED (
  SELECT vec_id AS row_id, 0 AS grp, CAST(embedding AS DOUBLE[]) AS x,
         CASE WHEN label < 5 THEN 1e0 ELSE 0e0 END AS y
  FROM embeddings)"""
EW = f"ew AS MATERIALIZED (SELECT grp, {drawn(H * (D + 1), 0.5, 0, 'grp')} AS w FROM (SELECT DISTINCT grp FROM e))"
EP = f"ep AS MATERIALIZED (SELECT e.grp, row_id, y, {net('x', 'w', D, H, 'tanh')} AS p FROM e JOIN ew ON e.grp = ew.grp)"


def by_neuron(name, data, models, w, d, h, hidden, output) -> str:
    """Scores ``s`` of every row and model through a table of hidden neurons; quick for wide networks."""
    return f"""{name}_n AS MATERIALIZED (
  SELECT grp, pid, {w}[j * {d} + 1 : (j + 1) * {d}] AS wj, {w}[{d * h} + j + 1] AS vj FROM {models}, range({h}) AS r(j)),
{name} AS MATERIALIZED (
  SELECT grp, pid, row_id, y, {act('z', output)} AS s
  FROM (SELECT m.grp, m.pid, d.row_id, d.y, sum({act('list_dot_product(d.x, m.wj)', hidden)} * m.vj) AS z
        FROM {data} d JOIN {name}_n m ON d.grp = m.grp GROUP BY m.grp, m.pid, d.row_id, d.y))"""


CW = (
    f"cw AS MATERIALIZED (SELECT grp, 0 AS pid, {drawn(CH * (CD + 1), 0.5, 0, 'grp')} AS w"
    " FROM (SELECT DISTINCT grp FROM c))"
)
CP = by_neuron("cp", "c", "cw", "w", CD, CH, "relu", "sigmoid")
THIRDS = (
    C + f""",
c3 AS MATERIALIZED (SELECT row_id, CAST(row_id % 3 AS INTEGER) AS grp, x, y FROM c),
w3 AS MATERIALIZED (SELECT grp, 0 AS pid, {drawn(CH * (CD + 1), 0.5, 0, 'grp')} AS w
  FROM (SELECT DISTINCT grp FROM c3 WHERE grp < 2))"""
)
L = "l AS (SELECT doc_id AS row_id, CAST(quality AS DOUBLE) AS y, CAST(toxic AS DOUBLE) AS p FROM labels)"
DECIDED = "CASE WHEN s < 0.5e0 THEN 0e0 ELSE 1e0 END"


def with_(*ctes) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def f1_of(tp, fp, fn) -> str:
    precision = f"({tp})::DOUBLE / nullif({tp} + {fp}, 0)"
    recall = f"({tp})::DOUBLE / nullif({tp} + {fn}, 0)"
    return f"(2e0 * (({precision}) * ({recall}))) / nullif(({precision}) + ({recall}), 0e0)"


def auc_of(source, by, y="y", s="s") -> str:
    """Positive-negative pairs counted through the number of negatives below and level with each score."""
    keys = ", ".join(by)
    comma = keys + ", " if by else ""
    over = f"PARTITION BY {keys} " if by else ""
    group = f"GROUP BY {keys}" if by else ""
    return f"""(SELECT {comma}CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives,
       sum(p * (below + n / 2e0)) / nullif(CAST(sum(p) AS DOUBLE) * CAST(sum(n) AS DOUBLE), 0e0) AS auc
  FROM (SELECT *, coalesce(sum(n) OVER ({over}ORDER BY {s} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM (SELECT {comma}{s}, count(*) FILTER ({y} = 1) AS p, count(*) FILTER ({y} <> 1) AS n
              FROM {source} GROUP BY {comma}{s})) {group})"""


# ---- swarm in SQL ------------------------------------------------------------------------------


def start(name, data, particles, size, limit, seed=0) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT grp, CAST(pid AS BIGINT) AS pid, {drawn(size, limit, 'pid', 'grp', seed=seed)} AS pos,
         {drawn(size, limit, 'pid', 'grp', first=size, seed=seed)} AS vel
  FROM (SELECT DISTINCT grp FROM {data}), range({particles}) AS r(pid))"""


def mse_fit(name, data, swarm, d, h, hidden) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT s.grp, s.pid, avg(pow(d.y - {net('d.x', 's.pos', d, h, hidden)}, 2)) AS fit
  FROM {data} d JOIN {swarm} s ON d.grp = s.grp GROUP BY s.grp, s.pid)"""


def bce_fit(name, data, swarm, d, h) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT grp, pid, -sum(y * ln(q) + (1e0 - y) * ln(1e0 - q)) AS fit
  FROM (SELECT s.grp, s.pid, d.y, greatest(1e-15, least(1e0 - 1e-15, {net('d.x', 's.pos', d, h, 'relu', 'sigmoid')})) AS q
        FROM {data} d JOIN {swarm} s ON d.grp = s.grp) GROUP BY grp, pid)"""


def auc_fit(name, data, swarm, d, h) -> str:
    return f"""{name}_s AS MATERIALIZED (
  SELECT s.grp, s.pid, d.y, {net('d.x', 's.pos', d, h, 'relu', 'sigmoid')} AS s
  FROM {data} d JOIN {swarm} s ON d.grp = s.grp),
{name} AS MATERIALIZED (SELECT grp, pid, 1e0 - auc AS fit FROM {auc_of(name + '_s', ['grp', 'pid'])})"""


def velocity(settings, size, t, lead="g", own="pb") -> str:
    pull = own if settings.social == "personal" else lead
    r1, r2 = lattice("pid", 0, "grp", t), lattice("pid", 1, "grp", t)
    return f"""list_transform(range(1, {size + 1}), lambda i: greatest({-settings.v_max}e0, least({settings.v_max}e0,
      {settings.inertia}e0 * vel[i] + ({settings.c1}e0 * {r1}) * ({own}[i] - pos[i])
      + ({settings.c2}e0 * {r2}) * ({pull}[i] - pos[i]))))"""


def position(settings, size) -> str:
    step = "pos[i] + v[i]"
    if settings.pos_max is not None:
        step = f"greatest({-settings.pos_max}e0, least({settings.pos_max}e0, {step}))"
    return f"list_transform(range(1, {size + 1}), lambda i: {step})"


def generations(prefix, data, settings, size, fit_of, particles, iterations) -> tuple[list[str], str, str]:
    """CTEs of a whole training; also the names of the last state and of the last leader table.

    State ``s<t>`` is (grp, pid, pos, vel, pb, pbf); leader ``g<t>`` is (grp, pos, fit).
    """
    ctes = [
        start(f"{prefix}0", data, particles, size, settings.init_range),
        f"{prefix}s0 AS (SELECT *, pos AS pb, CAST('Infinity' AS DOUBLE) AS pbf FROM {prefix}0)",
    ]
    for t in range(1, iterations + 1):
        before, p = f"{prefix}s{t - 1}", f"{prefix}{t}"
        ctes.append(fit_of(f"{p}f", data, before))
        ctes.append(f"""{p}u AS MATERIALIZED (
  SELECT b.grp, b.pid, pos, vel, CASE WHEN fit < pbf THEN pos ELSE pb END AS pb,
         CASE WHEN fit < pbf THEN fit ELSE pbf END AS pbf
  FROM {before} b JOIN {p}f f ON b.grp = f.grp AND b.pid = f.pid)""")
        known = f"SELECT grp, pid, pb, pbf FROM {p}u"
        if t > 1:
            known += f" UNION ALL SELECT grp, -1, pos, fit FROM {prefix}{t - 1}g"
        ctes.append(f"""{p}g AS MATERIALIZED (
  SELECT grp, pb AS pos, pbf AS fit FROM ({known})
  QUALIFY row_number() OVER (PARTITION BY grp ORDER BY pbf, pid) = 1)""")
        if settings.update == "async" and t > 1:
            ctes.append(f"""{p}l AS MATERIALIZED (
  SELECT u.grp, u.pid, k.pb AS g FROM {p}u u JOIN ({known}) k ON u.grp = k.grp AND k.pid <= u.pid
  QUALIFY row_number() OVER (PARTITION BY u.grp, u.pid ORDER BY k.pbf, k.pid) = 1)""")
            led = f"SELECT u.*, l.g FROM {p}u u JOIN {p}l l ON u.grp = l.grp AND u.pid = l.pid"
        else:
            led = f"SELECT u.*, l.pos AS g FROM {p}u u JOIN {p}g l ON u.grp = l.grp"
        ctes.append(f"""{prefix}s{t} AS MATERIALIZED (
  SELECT grp, pid, {position(settings, size)} AS pos, v AS vel, pb, pbf
  FROM (SELECT *, {velocity(settings, size, t)} AS v FROM ({led})))""")
    return ctes, f"{prefix}s{iterations}", f"{prefix}{iterations}g"


def demand_training(prefix, settings, hidden, data="e", particles=PARTICLES, iterations=None, h=SMALL_H):
    return generations(
        prefix, data, settings, h * (D + 1), lambda n, d, s: mse_fit(n, d, s, D, h, hidden), particles,
        iterations or settings.iterations,
    )


def spelled(keys, arrays, source, size) -> str:
    columns = ", ".join(f"{r6(f'{a}[i]')} AS {n}" for n, a in arrays.items())
    return f"SELECT {keys}, i - 1 AS k, {columns} FROM (SELECT *, unnest(range(1, {size + 1})) AS i FROM {source})"


def trained(settings, hidden, h=SMALL_H) -> str:
    ctes, _, leader = demand_training("t", settings, hidden, particles=settings.particles, h=h)
    return with_(E, *ctes) + spelled("grp, round(fit, 6) + 0e0 AS fit", {"pos": "pos"}, leader, h * (D + 1))


def trained_class(fit_of) -> str:
    size = 4 * (CD + 1)
    ctes, _, leader = generations(
        "t", "c", CLASS_SWARM, size, lambda n, d, s: fit_of(n, d, s, CD, 4), PARTICLES, CLASS_SWARM.iterations
    )
    return with_(C, *ctes) + spelled("grp, round(fit, 6) + 0e0 AS fit", {"pos": "pos"}, leader, size)


def generation_pair(settings, hidden) -> str:
    ctes, state, _ = demand_training("t", settings, hidden, iterations=2)
    return with_(E, *ctes) + spelled(
        "grp, pid, round(pbf, 6) + 0e0 AS pbest_fit", {"pos": "pos", "vel": "vel", "pbest": "pb"}, state, SMALL_W
    )


def curve_rows(prefix, iterations) -> str:
    return " UNION ALL ".join(
        f"SELECT grp, CAST({t - 1} AS BIGINT) AS iter, fit FROM {prefix}{t}g" for t in range(1, iterations + 1)
    )


EVALUATED = [
    E,
    start("s0", "e", PARTICLES, SMALL_W, FREE.init_range),
    start("s1", "e", PARTICLES, SMALL_W, FREE.init_range, seed=7),
    mse_fit("f0", "e", "s0", D, SMALL_H, "tanh"),
    mse_fit("f1", "e", "s1", D, SMALL_H, "tanh"),
    """u AS MATERIALIZED (
  SELECT a.grp, a.pid, b.pos, a.vel, CASE WHEN y.fit < x.fit THEN b.pos ELSE a.pos END AS pb,
         CASE WHEN y.fit < x.fit THEN y.fit ELSE x.fit END AS pbf
  FROM s0 a JOIN s1 b ON a.grp = b.grp AND a.pid = b.pid JOIN f0 x ON a.grp = x.grp AND a.pid = x.pid
  JOIN f1 y ON a.grp = y.grp AND a.pid = y.pid)""",
    "g AS MATERIALIZED (SELECT grp, pb AS pos, pbf AS fit FROM u"
    " QUALIFY row_number() OVER (PARTITION BY grp ORDER BY pbf, pid) = 1)",
]


def moved(settings) -> str:
    state = f"""m AS (SELECT grp, pid, {position(settings, SMALL_W)} AS pos, v AS vel
  FROM (SELECT *, {velocity(settings, SMALL_W, 3)} AS v
        FROM (SELECT u.*, g.pos AS g FROM u JOIN g ON u.grp = g.grp)))"""
    return with_(*EVALUATED, state) + spelled("grp, pid", {"pos": "pos", "vel": "vel"}, "m", SMALL_W)


def loss(value) -> str:
    size = CH * (CD + 1)
    scored = by_neuron("q", "c", "s0", "pos", CD, CH, "relu", "sigmoid")
    return with_(C, start("s0", "c", 5, size, 0.5), scored) + value


def per_particle(expression) -> str:
    return loss(f"SELECT grp, pid, {r6(expression)} AS loss FROM q GROUP BY grp, pid")


def counted(condition) -> str:
    return f"count(*) FILTER ({condition})"


def f1_loss(decided) -> str:
    return "1e0 - " + f1_of(
        counted(f"y = 1 AND {decided} = 1"), counted(f"y = 0 AND {decided} = 1"), counted(f"y = 1 AND {decided} = 0")
    )


def swept() -> str:
    ctes, parts = [E], []
    for n_rows in SWEEP_ROWS:
        data = "e"
        if n_rows is not None:
            data = f"e{n_rows}"
            ctes.append(f"{data} AS MATERIALIZED (SELECT * FROM e ORDER BY row_id LIMIT {n_rows})")
        for iterations in SWEEP_ITERATIONS:
            for particles in SWEEP_PARTICLES:
                prefix = f"r{n_rows or 'all'}_{iterations}_{particles}_"
                more, _, leader = demand_training(prefix, FREE, "tanh", data, particles, iterations)
                ctes += more
                run = f"rows={n_rows or 'all'},iters={iterations},parts={particles}"
                parts.append(f"SELECT '{run}' AS run_id, grp, {r6('fit')} AS fit FROM {leader}")
    return with_(*ctes) + " UNION ALL ".join(parts)


def compared() -> str:
    one, _, _ = demand_training("a", FREE, "tanh")
    two, _, _ = demand_training("b", BOUNDED, "identity")
    stacked = (
        f"k AS (SELECT 'sync' AS algo, * FROM ({curve_rows('a', FREE.iterations)})"
        f" UNION ALL SELECT 'async' AS algo, * FROM ({curve_rows('b', BOUNDED.iterations)}))"
    )
    return with_(E, *one, *two, stacked) + f"""SELECT algo, grp, {r6("max(fit) FILTER (iter = 0)")} AS first_fitness,
  {r6("min(fit)")} AS best_fitness, min(iter) FILTER (fit = low) AS reached_at, count(*) AS n_iters
FROM (SELECT *, min(fit) OVER (PARTITION BY algo, grp) AS low FROM k) GROUP BY algo, grp"""


def _two_layer() -> str:
    """Both hidden layers as tables of neurons; quick for wide networks."""
    h = CH
    weights = f"w2 AS MATERIALIZED (SELECT grp, {drawn(h * (CD + h + 1), 0.5, 0, 'grp')} AS w FROM (SELECT DISTINCT grp FROM c))"
    neurons = f"""n1 AS MATERIALIZED (SELECT grp, j, w[j * {CD} + 1 : (j + 1) * {CD}] AS wj FROM w2, range({h}) AS r(j)),
n2 AS MATERIALIZED (SELECT grp, w[{CD * h} + j * {h} + 1 : {CD * h} + (j + 1) * {h}] AS wj,
  w[{CD * h + h * h} + j + 1] AS vj FROM w2, range({h}) AS r(j))"""
    first = f"""z1 AS MATERIALIZED (SELECT c.grp, row_id, list({act('list_dot_product(x, wj)', 'relu')} ORDER BY j) AS z
  FROM c JOIN n1 ON c.grp = n1.grp GROUP BY c.grp, row_id)"""
    second = f"sum({act('list_dot_product(z, wj)', 'relu')} * vj)"
    return with_(C, weights, neurons, first) + f"""SELECT row_id, {r6(second)} AS predicted
FROM z1 JOIN n2 ON z1.grp = n2.grp GROUP BY row_id"""


def oracles() -> dict[str, str]:
    class_confusion = (counted(f"y = 1 AND {DECIDED} = 1"), counted(f"y = 0 AND {DECIDED} = 1"),
                       counted(f"y = 1 AND {DECIDED} = 0"))
    pair_confusion = (counted("y = 1 AND p = 1"), counted("y = 0 AND p = 1"), counted("y = 1 AND p = 0"))
    clipped = "greatest(1e-15, least(1e0 - 1e-15, s))"
    entropy = f"-sum(y * ln({clipped}) + (1e0 - y) * ln(1e0 - {clipped}))"
    lines = """m AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber) AS rid
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
    seen = [
        f"{n} AS (SELECT {c} AS v, row_number() OVER (ORDER BY min(rid)) - 1 AS i FROM m GROUP BY {c})"
        for n, c in (("va", "l_returnflag"), ("vb", "l_linestatus"), ("vc", "o_orderpriority"))
    ]
    coded = """n AS MATERIALIZED (SELECT m.*, va.i AS ia, (SELECT count(*) FROM va) + vb.i AS ib,
         (SELECT count(*) FROM va) + (SELECT count(*) FROM vb) + vc.i AS ic,
         (SELECT count(*) FROM va) + (SELECT count(*) FROM vb) + (SELECT count(*) FROM vc) AS base
  FROM m JOIN va ON l_returnflag = va.v JOIN vb ON l_linestatus = vb.v JOIN vc ON o_orderpriority = vc.v)"""
    cells = ", ".join(
        f"CASE WHEN {i} IN (ia, ib, ic) THEN 1e0 WHEN {i} < base THEN 0e0 WHEN {i} = base THEN l_quantity"
        f" WHEN {i} = base + 1 THEN l_extendedprice WHEN {i} = base + 2 THEN l_discount"
        f" WHEN {i} = base + 3 THEN l_tax END AS x{i}"
        for i in range(14)
    )
    sync, _, led = demand_training("t", FREE, "tanh")
    keyed = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
    parts = "vp AS (SELECT l_partkey AS v, row_number() OVER (ORDER BY min(rid)) - 1 AS i FROM m GROUP BY l_partkey)"

    def weight(at):
        return f"CASE WHEN {at} IS NULL THEN 0e0 ELSE (({at}) * 7919 % 1000) / 1000e0 END"

    model = drawn(SMALL_W, 0.5, 0, "grp")
    return {
        "clean_limit": """SELECT c_custkey AS row_id, c_acctbal AS balance FROM customer
WHERE c_mktsegment <> 'HOUSEHOLD' AND c_acctbal IS NOT NULL ORDER BY c_custkey LIMIT 500""",
        "limit_large": """SELECT day, count(*) AS n_rows FROM (
  SELECT CASE WHEN l_returnflag <> 'A' THEN strftime(l_shipdate, '%Y-%m-%d') END AS day FROM lineitem
  ORDER BY day NULLS FIRST LIMIT (SELECT count(*) // 3 FROM lineitem)) GROUP BY day""",
        "leading_columns": """SELECT c_custkey, c_mktsegment AS label, k, CAST([c_custkey, c_nationkey, c_acctbal][k + 1] AS DOUBLE) AS v
FROM customer, range(3) AS r(k)""",
        "fixed_decimals": "SELECT event_id, printf('%.16f', floor(value) / 8e0) AS text FROM events",
        "label_decode": "SELECT doc_id, CASE quality WHEN 0 THEN 0e0 WHEN 1 THEN 1e0 END AS y FROM labels",
        "calendar_parts": """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M:%S') AS time,
  strftime(ts, '%H') AS hour, strftime(ts, '%M') AS minute, upper(dayname(ts)) AS weekday,
  upper(monthname(ts)) AS month, lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || ':00' AS label FROM events""",
        "onehot_first_seen": """WITH v AS (SELECT event_type AS t, row_number() OVER (ORDER BY min(event_id)) - 1 AS k
  FROM events GROUP BY event_type)
SELECT event_id, k, CASE WHEN event_type = t THEN 1e0 ELSE 0e0 END AS v FROM events, v""",
        "assemble_calendar": with_(E) + f"""SELECT row_id AS event_id, i - 1 AS k, {r6('x[i]')} AS v
FROM (SELECT row_id, x, unnest(range(1, 15)) AS i FROM e)""",
        "assemble_mixed": with_(lines, *seen, coded) + f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {cells} FROM n",
        "dims": with_(C) + """SELECT count(*) AS n_rows, min(len(x)) AS min_width, max(len(x)) AS n_inputs,
  count(*) FILTER (x IS NULL) AS null_x, count(*) FILTER (y IS NULL) AS null_y,
  CAST(floor(1.9e0 * max(len(x))) AS BIGINT) AS n_hidden,
  CAST(floor(1.9e0 * max(len(x))) AS BIGINT) * (max(len(x)) + 1) AS n_weights FROM c""",
        "linear_predict": with_(C) + f"SELECT row_id, {r6(f'list_dot_product(x, {drawn(CD, 1.0, 0, 0)})')} AS h FROM c",
        "activations": f"""SELECT event_id, {r6('greatest(0e0, v)')} AS relu,
  {r6('CASE WHEN v > 0 THEN v ELSE 0e0 END')} AS relu_if, {r6('1e0 / (1e0 + exp(-v))')} AS sigmoid,
  {r6('tanh(v)')} AS tanh, CASE WHEN v < 0.5e0 THEN 0e0 ELSE 1e0 END AS threshold,
  CAST(sign(v) AS DOUBLE) AS sign, {r6('greatest(1e-15, least(1e0 - 1e-15, v))')} AS clipped,
  {r6('greatest(-0.48e0, least(0.48e0, v))')} AS clamped, {r6('pow(v - 1e0, 2)')} AS squared_error
FROM (SELECT event_id, (value - 100e0) / 50e0 AS v FROM events)""",
        "forward_identity": with_(E, EW)
        + f"SELECT row_id, {r6(net('x', 'w', D, H, 'identity'))} AS predicted FROM e JOIN ew ON e.grp = ew.grp",
        "forward_tanh": with_(E, EW, EP) + f"SELECT row_id, {r6('p')} AS predicted FROM ep",
        "forward_class": with_(C, CW, CP) + f"SELECT row_id, {r6('s')} AS predicted FROM cp",
        "forward_two_layer": _two_layer(),
        "hourly_predict": with_(E, EW, EP) + f"SELECT grp, row_id, {r6('y')} AS real, {r6('p')} AS predicted FROM ep",
        "class_predict": with_(C, CW, CP) + f"SELECT row_id, y AS real, {r6('s')} AS score, {DECIDED} AS predicted FROM cp",
        "rows_per_hour": """SELECT CAST(hour(ts) AS INTEGER) AS grp, lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || ':00' AS label,
  count(*) AS n_rows FROM events GROUP BY 1, 2""",
        "hourly_mse": with_(E, EW, EP) + f"SELECT grp, {r6('avg(pow(y - p, 2))')} AS mse FROM ep GROUP BY grp",
        "macro_mse": with_(E, EW, EP)
        + f"SELECT {r6('avg(m)')} AS macro_mse FROM (SELECT grp, avg(pow(y - p, 2)) AS m FROM ep GROUP BY grp)",
        "pair_mse": with_(E) + f"SELECT {r6('avg(pow(y - x[14], 2))')} AS mse FROM e",
        "accuracy": with_(L) + f"SELECT {r6('avg(CASE WHEN y = p THEN 1e0 ELSE 0e0 END)')} AS accuracy FROM l",
        "class_counts": with_(L) + """SELECT count(*) AS n_rows, count(*) FILTER (y = 1) AS real_ones,
  count(*) FILTER (p = 1) AS predicted_ones FROM l""",
        "f1": with_(L) + f"""SELECT {pair_confusion[0]} AS tp, {pair_confusion[1]} AS fp, {pair_confusion[2]} AS fn,
  {r6(f1_of(*pair_confusion))} AS f1 FROM l""",
        "bce": with_(C, CW, CP) + f"SELECT {r6(entropy)} AS bce FROM cp",
        "auc": with_(C, CW, CP) + f"SELECT positives, negatives, {r6('auc')} AS auc FROM {auc_of('cp', [])}",
        "auc_hourly": with_(E, EW, EP, "h AS (SELECT grp, CASE WHEN y > 1 THEN 1 ELSE 0 END AS y, round(p, 9) + 0e0 AS s FROM ep)")
        + f"SELECT grp, positives, negatives, {r6('auc')} AS auc FROM {auc_of('h', ['grp'])}",
        "auc_literal": with_(C) + """SELECT count(*) FILTER (y = 1) AS positives, count(*) FILTER (y <> 1) AS negatives,
  round(1e0 / (2 * count(*) FILTER (y <> 1)), 9) AS auc FROM c""",
        "predict_unlabelled": with_(THIRDS, by_neuron("u", "c3", "w3", "w", CD, CH, "relu", "sigmoid"))
        + f"SELECT c3.grp, 'v' || c3.row_id AS name, {r6('s')} AS predicted FROM c3 LEFT JOIN u USING (row_id)",
        "evaluate_bce": with_(THIRDS, by_neuron("u", "c3", "w3", "w", CD, CH, "relu", "sigmoid"))
        + f"SELECT {r6(entropy)} AS bce FROM u",
        "evaluate_limit": with_(C, CW, CP, "f AS (SELECT * FROM cp ORDER BY row_id LIMIT 100)")
        + f"SELECT {r6(f'avg(CASE WHEN y = {DECIDED} THEN 0e0 ELSE 1e0 END)')} AS loss FROM f",
        "in_out_errors": with_(C, CW, CP) + "SELECT " + ", ".join(
            f"{r6(f'avg(CASE WHEN y = {DECIDED} THEN 0e0 ELSE 1e0 END) FILTER ({rows})')} AS error_{name},"
            f" count(*) FILTER ({rows}) AS rows_{name}"
            for name, rows in (("in", "row_id % 5 <> 0"), ("out", "row_id % 5 = 0"))
        ) + f", {CD} AS n_inputs, {CH} AS n_hidden FROM cp",
        "report_lines": with_(E, EW, EP) + """SELECT grp AS hour, 1 AS part, row_id,
  printf('%.16f', floor(y)) || ' ' || printf('%.16f', floor(p)) AS line FROM ep
UNION ALL SELECT DISTINCT grp, 0, -1, lpad(CAST(grp AS VARCHAR), 2, '0') || ':00' FROM ep""",
        "model_lines": with_(E) + f"""SELECT grp, array_to_string(list_transform({drawn(SMALL_W, 0.5, 0, 'grp')},
  lambda w: CAST(floor(w * 8e0) / 8e0 AS VARCHAR)), ', ') AS line FROM (SELECT DISTINCT grp FROM e)""",
        "summary": with_(C, CW, CP) + f"""SELECT count(*) AS n_rows, count(*) FILTER (y = 1) AS real_ones,
  count(*) FILTER ({DECIDED} = 1) AS predicted_ones,
  {r6(f"1e0 - avg(CASE WHEN y = {DECIDED} THEN 1e0 ELSE 0e0 END)")} AS error,
  {CD} AS n_inputs, {CH} AS n_hidden FROM cp""",
        "loss_error": per_particle(f"avg(CASE WHEN y = {DECIDED} THEN 0e0 ELSE 1e0 END)"),
        "loss_bce": per_particle(entropy),
        "loss_mse": per_particle("avg(pow(y - s, 2))"),
        "loss_f1": per_particle(f1_loss(DECIDED)),
        "loss_f1_signum": per_particle(f1_loss("sign(s)")),
        "loss_auc": loss(f"SELECT grp, pid, {r6('1e0 - auc')} AS loss FROM {auc_of('q', ['grp', 'pid'])}"),
        "evaluate_error": with_(C, CW, CP)
        + f"SELECT {r6(f'avg(CASE WHEN y = {DECIDED} THEN 0e0 ELSE 1e0 END)')} AS loss FROM cp",
        "evaluate_f1": with_(C, CW, CP) + f"SELECT {r6('1e0 - ' + f1_of(*class_confusion))} AS loss FROM cp",
        "evaluate_f1_signum": with_(C, CW, CP) + f"SELECT {r6(f1_loss('sign(s)'))} AS loss FROM cp",
        "evaluate_auc": with_(C, CW, CP) + f"SELECT {r6('1e0 - auc')} AS loss FROM {auc_of('cp', [])}",
        "swarm_init": with_(E, start("s0", "e", PARTICLES, SMALL_W, FREE.init_range))
        + spelled("grp, pid", {"pos": "pos", "vel": "vel"}, "s0", SMALL_W),
        "swarm_fitness": with_(*EVALUATED) + f"SELECT grp, pid, {r6('fit')} AS fit FROM f0",
        "swarm_fitness_expression": with_(*EVALUATED) + f"SELECT grp, pid, {r6('fit')} AS fit FROM f0",
        "swarm_pbest": with_(*EVALUATED)
        + spelled("grp, pid, round(pbf, 6) + 0e0 AS pbest_fit", {"pbest": "pb"}, "u", SMALL_W),
        "swarm_gbest": with_(*EVALUATED) + spelled("grp, round(fit, 6) + 0e0 AS fit", {"pos": "pos"}, "g", SMALL_W),
        "swarm_gbest_running": with_(*EVALUATED, """w AS (
  SELECT u.grp, u.pid, k.pb AS g, k.pbf AS f FROM u JOIN u k ON u.grp = k.grp AND k.pid <= u.pid
  QUALIFY row_number() OVER (PARTITION BY u.grp, u.pid ORDER BY k.pbf, k.pid) = 1)""")
        + spelled("grp, pid, round(f, 6) + 0e0 AS gbest_fit", {"gbest": "g"}, "w", SMALL_W),
        "swarm_move_free": moved(FREE),
        "swarm_move_bounded": moved(BOUNDED),
        "swarm_move_personal": moved(PERSONAL),
        "generation_sync": generation_pair(FREE, "tanh"),
        "generation_async": generation_pair(BOUNDED, "identity"),
        "train_sync": trained(FREE, "tanh"),
        "train_async": trained(BOUNDED, "tanh"),
        "train_published_width": trained(PUBLISHED, "tanh", H),
        "train_per_hour": trained(BOUNDED, "identity"),
        "train_personal": trained(PERSONAL, "identity"),
        "train_class_bce": trained_class(bce_fit),
        "train_class_auc": trained_class(auc_fit),
        "curve": with_(E, *sync)
        + f"SELECT grp, iter, {r6('fit')} AS best_fitness FROM ({curve_rows('t', FREE.iterations)})",
        "curve_compare": compared(),
        "sweep": swept(),
        "onehot_wide": with_(lines, parts) + f"SELECT {keyed}, i AS place FROM m JOIN vp ON l_partkey = v",
        "sparse_wide": with_(lines, seen[0], parts) + f"""SELECT {keyed}, {r6(
            f"{weight('vp.i')} + {weight('vp_n + va.i')} + l_quantity * {weight('vp_n + va_n')}")} AS score
FROM m JOIN vp ON l_partkey = vp.v JOIN va ON l_returnflag = va.v,
  (SELECT count(*) AS vp_n FROM vp), (SELECT count(*) AS va_n FROM va)""",
        "csv_roundtrip": """SELECT row_number() OVER (ORDER BY event_id) - 1 AS number, event_id, event_type, value
FROM events""",
        "cells_roundtrip": with_(E) + f"""SELECT CAST({SMALL_W} AS BIGINT) AS n_weights, {r6('w[1]')} AS w0, {r6('w[2]')} AS w1,
  {r6('w[45]')} AS w44 FROM (SELECT {model} AS w FROM (SELECT DISTINCT grp FROM e))""",
        "curve_file": with_(E, *sync)
        + f"SELECT 'sync' AS algo, grp, iter, {r6('fit')} AS best_fitness FROM ({curve_rows('t', FREE.iterations)})",
        "class_results_file": with_(C, CW, CP) + f"""SELECT y AS real, {DECIDED} AS predicted, 2 * count(*) AS n_rows
FROM cp GROUP BY ALL""",
        "runs_file": with_(E, *sync) + f"""SELECT 'train_mse' AS metric, CAST({FREE.iterations} AS BIGINT) AS iters,
  CAST({PARTICLES} AS BIGINT) AS parts, (SELECT count(*) FROM e) AS n_rows, {r6('avg(fit)')} AS value FROM {led}""",
    }
