"""The registered queries once more, as SQL for DuckDB over the same tables.

Written from the semantics, not from the DataFrame plans: row_number instead of min/max of structs, plain
window sums instead of array folds, ungrouped base rows instead of merged partial sums.
"""

from __future__ import annotations

from matchlake.operators.compare import TEXTS
from matchlake.plans import registry
from matchlake.plans.registry import AUDIT_LIMIT, AUDIT_SECONDS, CHAMPION, CHAMPION_NAME, FROM_MS, NOW_S, PATCH, TO_MS
from matchlake.sources.star import HIGH_LEAGUES

LANES = "['TOP','JUNGLE','MIDDLE','BOTTOM','UTILITY']"


def rnd(x: str, d: int) -> str:
    p = f"1e{d}"
    return f"(sign(({x})::DOUBLE) * floor(abs(({x})::DOUBLE) * {p} + 0.5) / {p} + 0.0)"


def pct(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif({b}, 0) * 1e2, 0.0)"


def micros(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5)::BIGINT"


def mean(x: str, n: str = "count(*)") -> str:
    return f"coalesce(sum({micros(x)})::DOUBLE / 1e6 / nullif({n}, 0), 0.0)"


def number(x: str) -> str:
    return f"regexp_replace(({rnd(x, 1)})::DECIMAL(30,1)::VARCHAR, '\\.?0+$', '')"


BASE = f"""
m AS (
  SELECT o_orderkey AS mid, o_custkey AS cust, o_orderstatus AS status, year(o_orderdate) AS y, quarter(o_orderdate) AS q,
    date_diff('day', DATE '1970-01-01', o_orderdate::DATE) * 86400000 + (o_orderkey * 7919 % 86400) * 1000 + 123 AS created,
    900 + 60 * (o_orderkey % 31) AS duration,
    CASE WHEN o_orderpriority LIKE '5%' THEN 440 ELSE 420 END AS queue,
    (year(o_orderdate) - 1985)::VARCHAR || '.' || quarter(o_orderdate)::VARCHAR AS patch
  FROM orders),
p AS (
  SELECT *, (k + a) / CASE WHEN dd = 0 THEN 1 ELSE dd END::DOUBLE AS kda, (team = 100) = (mid % 2 = 0) AS win,
    (len - 1) * (4 + qty % 5) + part % 3 AS last_cs,
    CASE WHEN len > 15 THEN 15 * (4 + qty % 5) + part % 3 ELSE 0 END AS cs15,
    CASE WHEN len > 15 THEN 500 + 15 * (200 + part % 300) + (supp * 225) % 53 * 60 ELSE 0 END AS gold15,
    CASE WHEN len > 15 THEN 15 * (300 + supp % 200) ELSE 0 END AS xp15
  FROM (
    SELECT l_orderkey AS mid, l_suppkey AS supp, l_partkey AS part, floor(l_quantity)::BIGINT AS qty,
      l_linenumber::BIGINT * 1000000000000 + l_partkey AS pos,
      least(l_partkey % 50, (l_partkey // 50) % 50) AS champ,
      CASE WHEN l_linestatus = 'O' THEN 100 ELSE 200 END AS team,
      {LANES}[(l_linenumber - 1) % 5 + 1] AS role,
      l_partkey % 3 AS solok, l_linenumber % 2 AS solod, floor(l_quantity)::BIGINT % 15 AS k, l_partkey % 11 AS dd, l_suppkey % 20 AS a,
      floor(l_extendedprice / 4)::BIGINT AS gold, floor(l_extendedprice / 3)::BIGINT AS damage,
      floor(l_extendedprice / 5)::BIGINT + l_partkey % 1000 AS taken, l_suppkey % 60 + l_linenumber AS vision,
      15 + l_orderkey % 31 - CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS len
    FROM lineitem)),
g AS (
  SELECT p.*, m.created, m.duration, m.queue, m.patch, m.y, m.q,
    damage / (duration / 6e1) AS dpm, gold / (duration / 6e1) AS gpm, last_cs / (duration / 6e1) AS cspm
  FROM p JOIN m USING (mid)),
bans AS (
  SELECT mid, team, b AS champ, patch, queue FROM (
    SELECT m.*, 100 AS team, unnest([cust % 50, (mid // 7) % 50]) AS b FROM m
    UNION ALL SELECT m.*, 200 AS team, unnest([(cust * 3 + 1) % 50, cust % 50]) AS b FROM m) WHERE b > 0),
cat AS (
  SELECT p_size AS champ, 'Champ' || p_size AS cid,
    (SELECT string_agg(upper(w[1]) || lower(w[2:]), ' ') FROM (SELECT unnest(string_split(min(p_name), ' ')) AS w)) || ' ' || p_size AS cname,
    'the ' || min(p_name) AS title
  FROM part GROUP BY p_size),
usr AS (SELECT s_suppkey AS puuid, s_name AS name FROM supplier),
pairs AS (SELECT puuid AS hero, puuid + 1 - 2 * (puuid % 2) AS villain FROM usr),
games AS (SELECT cust AS puuid, mid, created, queue, status FROM m),
ev AS (
  SELECT event_id // 60 AS block, event_id % 60 AS i, user_id AS u, event_type AS kind, floor(value)::BIGINT AS v,
    json_extract_string(props, '$.k')::BIGINT AS k, epoch_us(ts) // 1000 AS ms FROM events),
blk AS (SELECT block, sum(k)::BIGINT AS k, sum(v)::BIGINT AS v, min(ms) AS t, max(i) AS last_i FROM ev GROUP BY block),
doc AS (
  SELECT block, 'EV_' || block AS mid, n, k, v, t, 'P' || ((block * 3 + n * 7) % 97) AS puuid, 1 + (block + n * n) % 50 AS champ,
    CASE WHEN n <= 5 THEN 100 ELSE 200 END AS team, {LANES}[(n - 1) % 5 + 1] AS lane0,
    CASE WHEN (block + n) % 22 = 0 THEN '' ELSE {LANES}[(n - 1) % 5 + 1] END AS ind,
    CASE WHEN (block + n) % 11 = 0 THEN CASE WHEN (block + n) % 22 = 0 THEN '' ELSE {LANES}[(n - 1) % 5 + 1] END
      ELSE {LANES}[(n - 1) % 5 + 1] END AS role,
    ((n <= 5) = (k % 2 = 0)) AS win
  FROM blk, range(1, 11) r(n)),
ids AS (
  SELECT block, 'EV_' || block AS mid, n, last_i,
    CASE WHEN n = 2 AND block % 9 = 0 THEN 'X' || block ELSE 'P' || ((block * 3 + n * 7) % 97) END AS puuid
  FROM blk, range(1, 11) r(n) WHERE n < 10 OR block % 7 <> 0),
fr AS (
  SELECT ids.block, ids.mid, ids.n, ids.puuid, ev.i, ev.u, ev.v, ev.i * 40000 // 60000 AS minute
  FROM ids JOIN ev USING (block) WHERE (n + u) % 4 <> 0),
ser AS (
  SELECT b.mid, b.puuid, b.n, b.minute, coalesce(f.gold, 0) AS gold, coalesce(f.xp, 0) AS xp, coalesce(f.cs, 0) AS cs,
    coalesce(f.damage, 0) AS damage
  FROM (
    SELECT mid, puuid, n, unnest(range(greatest(any_value(len), coalesce(max(minute) + 1, 0)))) AS minute FROM (
      SELECT ids.mid, ids.puuid, ids.n, CASE WHEN last_i = 0 THEN 40 ELSE ceil(last_i * 40000 / 6e4)::BIGINT END AS len, fr.minute
      FROM ids LEFT JOIN fr ON ids.block = fr.block AND ids.n = fr.n) GROUP BY mid, puuid, n) b
  LEFT JOIN (
    SELECT mid, n, minute, 500 + i * 90 + v % 50 * n AS gold, i * 110 + u % 20 * n AS xp, i + n + u % 5 AS cs, (v + i * 20) * n AS damage
    FROM fr QUALIFY row_number() OVER (PARTITION BY mid, n, minute ORDER BY i DESC) = 1) f
  ON b.mid = f.mid AND b.n = f.n AND b.minute = f.minute),
itm0 AS (
  SELECT block, u % 3 + 1 AS n, i, 1000 + k % 4 AS item,
    CASE WHEN kind = 'purchase' THEN 'BUY' WHEN kind = 'signup' THEN 'UNDO' ELSE 'SELL' END AS type
  FROM ev WHERE kind = 'purchase' OR (kind = 'signup' AND k % 2 = 1) OR (kind = 'error' AND k % 5 = 0)),
itm1 AS (
  SELECT *, sum(CASE type WHEN 'BUY' THEN 1 WHEN 'UNDO' THEN -1 ELSE 0 END) OVER (PARTITION BY block, n, item ORDER BY i) AS level FROM itm0),
itm AS (
  SELECT block, n, i, item, type, row_number() OVER (PARTITION BY block, n ORDER BY i) - 1 AS place FROM (
    SELECT *, min(level) OVER (PARTITION BY block, n, item ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM itm1)
  WHERE NOT (type = 'BUY' AND coalesce(later < level, false))),
obj AS (
  SELECT block, 'EV_' || block AS mid, row_number() OVER (PARTITION BY block ORDER BY i) - 1 AS place,
    CASE WHEN k % 5 = 1 THEN CASE WHEN k % 2 = 0 THEN 'DRAGON' ELSE 'HORDE' END
      WHEN k % 4 = 0 THEN 'INHIBITOR' ELSE 'TOWER' END AS type,
    CASE WHEN k % 5 = 1 THEN CASE WHEN k % 3 = 0 THEN 'FIRE' END WHEN k % 2 = 0 THEN 'TOP_LANE' ELSE 'MID_LANE' END AS sub,
    CASE WHEN k % 5 = 1 THEN CASE WHEN k % 2 = 0 THEN 100 ELSE 200 END WHEN k % 3 = 0 THEN 100 ELSE 200 END AS team,
    i * 40000 + 500 AS ts, u % 11 AS killer
  FROM ev WHERE kind = 'error' AND k % 5 IN (1, 2)),
final_items AS (
  SELECT block, n, string_agg(item::VARCHAR, ',' ORDER BY first_i) AS items FROM (
    SELECT block, n, item, min(i) AS first_i FROM itm WHERE type = 'BUY' GROUP BY block, n, item
    QUALIFY row_number() OVER (PARTITION BY block, n ORDER BY min(i) DESC) <= 6) GROUP BY block, n)
"""

# Rates per champion, patch and queue, scored against the quarter before.
_NORM = (
    "(greatest(0.0, least(1e2, ({0}wr - 45) * 10)) * 0.35e0 + greatest(0.0, least(1e2, {0}br * 10)) * 0.25e0 "
    "+ greatest(0.0, least(1e2, {0}pr)) * 0.15e0 + least(1e2, {0}kda / 3e0 * 100) * 0.1e0 "
    "+ greatest(0.0, least(1e2, {0}dpm / 1200 * 100)) * 0.08e0 + greatest(0.0, least(1e2, {0}gpm / 600 * 100)) * 0.04e0 "
    "+ greatest(0.0, least(1e2, {0}cspm / 8.5e0 * 100)) * 0.03e0) "
    "* CASE WHEN {0}games >= 500 THEN 1e0 WHEN {0}games >= 200 THEN 0.97e0 WHEN {0}games >= 100 THEN 0.94e0 "
    "WHEN {0}games >= 50 THEN 0.9e0 ELSE 0e0 END"
)

CHAMPIONS = f"""
st AS (
  SELECT s.*, {pct('coalesce(b.n, 0)', 'x.n')} AS br, {pct('games', 'x.n')} AS pr
  FROM (
    SELECT champ, patch, queue, any_value(y) AS y, any_value(q) AS q, count(*) AS games, sum(win::INT) AS wins, {pct('sum(win::INT)', 'count(*)')} AS wr,
      {mean('kda')} AS kda, {mean('dpm')} AS dpm, {mean('gpm')} AS gpm, {mean('cspm')} AS cspm
    FROM g GROUP BY champ, patch, queue) s
  JOIN (SELECT patch, queue, count(*) AS n FROM m GROUP BY patch, queue) x USING (patch, queue)
  LEFT JOIN (SELECT champ, patch, queue, count(DISTINCT mid) AS n FROM bans GROUP BY ALL) b USING (champ, patch, queue)),
sc AS (
  SELECT c.*, CASE WHEN c.games < 50 THEN 0e0 WHEN o.games >= 50 THEN
      ({_NORM.format('c.')}) * 0.7e0 + ({_NORM.format('o.')}) * 0.3e0
      + CASE WHEN c.wr - o.wr > 2 AND c.br - o.br > 1 THEN 5 WHEN c.wr - o.wr < -2 AND c.br - o.br < -1 THEN -5 ELSE 0 END
    ELSE {_NORM.format('c.')} END AS score
  FROM st c LEFT JOIN st o ON c.champ = o.champ AND c.queue = o.queue AND c.y * 4 + c.q - 1 = o.y * 4 + o.q),
tier AS (
  SELECT *, CASE WHEN games < 50 THEN 'Dados Insuficientes' WHEN score >= 80 AND wr > 51 AND br > 5 THEN 'S+'
      WHEN score >= 70 THEN 'S' WHEN score >= 55 THEN 'A' WHEN score >= 40 THEN 'B' WHEN score >= 30 THEN 'C' ELSE 'D' END AS tier
  FROM sc)
"""


def ranked(rows: str) -> str:
    return (
        f"SELECT *, CASE WHEN games >= 50 THEN row_number() OVER (PARTITION BY patch, queue, games >= 50 "
        f"ORDER BY score DESC, champ) END AS rank FROM {rows}"
    )


_RATE_COLUMNS = ", ".join(
    f"{rnd(c, 2)} AS \"{n}\""
    for c, n in [("wr", "winRate"), ("kda", "kda"), ("dpm", "dpm"), ("cspm", "cspm"), ("gpm", "gpm"), ("br", "banRate"), ("pr", "pickRate")]
)

# Games twice, for their patch and for the lifetime row; with the lane opponent's values at minute 15.
PLAYERS = f"""
opp AS (
  SELECT a.mid, a.role, a.team, b.supp AS osupp, b.champ AS ochamp, b.cs15 AS ocs, b.gold15 AS ogold, b.xp15 AS oxp, b.kda AS okda,
    b.damage AS odamage, b.gold AS ogolde, b.last_cs AS olast, b.vision AS ovision, b.taken AS otaken
  FROM (SELECT DISTINCT mid, role, team FROM p) a
  JOIN (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY mid, role, team ORDER BY pos, supp, cs15, gold15, xp15) = 1) b
    ON a.mid = b.mid AND a.role = b.role AND a.team <> b.team),
gg AS (
  SELECT g.* EXCLUDE (patch), e.patch, ocs, ogold, oxp, opp.mid IS NOT NULL AS met
  FROM g LEFT JOIN opp USING (mid, role, team), LATERAL (SELECT unnest([g.patch, 'ALL']) AS patch) e),
ps AS (
  SELECT supp AS puuid, patch, queue, count(*) AS games, sum(win::INT) AS wins, {rnd(pct('sum(win::INT)', 'count(*)'), 2)} AS wr,
    {rnd(mean('kda'), 2)} AS kda, {rnd(mean('dpm'), 2)} AS dpm, {rnd(mean('gpm'), 2)} AS gpm, {rnd(mean('cspm'), 2)} AS cspm,
    {rnd('sum(vision)::DOUBLE / count(*)', 2)} AS vision, sum(solok) AS solok, sum(solod) AS solod, max(created) AS last
  FROM gg GROUP BY supp, patch, queue),
pcs AS (
  SELECT supp AS puuid, champ, patch, queue, count(*) AS games, sum(win::INT) AS wins, {rnd(pct('sum(win::INT)', 'count(*)'), 2)} AS wr,
    {rnd(mean('kda'), 2)} AS kda, {rnd(mean('dpm'), 2)} AS dpm, {rnd(mean('gpm'), 2)} AS gpm, {rnd(mean('cspm'), 2)} AS cspm,
    {rnd('sum(vision)::DOUBLE / count(*)', 2)} AS vision, sum(solok) AS solok, sum(solod) AS solod,
    {rnd('coalesce(sum(cs15 - ocs)::DOUBLE / nullif(sum(met::INT), 0), 0e0)', 2)} AS csd,
    {rnd('coalesce(sum(gold15 - ogold)::DOUBLE / nullif(sum(met::INT), 0), 0e0)', 2)} AS gd,
    {rnd('coalesce(sum(xp15 - oxp)::DOUBLE / nullif(sum(met::INT), 0), 0e0)', 2)} AS xpd,
    sum((role = 'MIDDLE')::INT) AS mids, max(created) AS last
  FROM gg GROUP BY supp, champ, patch, queue),
topc AS (
  SELECT puuid, patch, queue, champ, games, wr, row_number() OVER (PARTITION BY puuid, patch, queue ORDER BY games DESC, champ) AS place
  FROM pcs QUALIFY place <= 5)
"""

CELLS = f"""
cells AS (
  SELECT supp AS puuid, dow, hour, count(*) AS games, sum(win::INT) AS wins, {pct('sum(win::INT)', 'count(*)')} AS wr FROM (
    SELECT *, extract(dow FROM lt) AS dow, extract(hour FROM lt) AS hour FROM (
      SELECT *, timezone('America/Sao_Paulo', to_timestamp(created // 1000)) AS lt FROM g WHERE queue = 420))
  GROUP BY supp, dow, hour)
"""

HIST = f"""
hist AS (
  SELECT supp AS puuid, mid, champ, role, k, dd, a, kda, gold, damage, vision, {rnd('cspm', 2)} AS cspm, win, created, duration, queue, pos
  FROM g WHERE queue = 420)
"""
_HIST_OUT = (
    'puuid, {place} AS place, mid AS "matchId", champ AS "championId", \'Champion \' || champ AS "championName", role, role || \'_LANE\' AS lane, k AS kills, dd AS deaths, a AS assists, kda, '
    'gold AS "goldEarned", damage AS "totalDamage", vision AS "visionScore", cspm, win, created AS "gameCreation", '
    'duration AS "gameDuration", queue AS "queueId", total > {upto} AS "hasMore", '
    'CASE WHEN total > {upto} THEN max(CASE WHEN place0 = {upto} THEN mid END) OVER (PARTITION BY puuid) END AS "nextCursor"'
)


def history_sql(rows: str, order: str, skip: int, limit: int) -> str:
    upto = skip + limit
    out = _HIST_OUT.format(place=f"place0 - {skip}", upto=upto)
    return (
        f"SELECT {out} FROM (SELECT *, row_number() OVER (PARTITION BY puuid ORDER BY {order}) AS place0, "
        f"count(*) OVER (PARTITION BY puuid) AS total FROM {rows}) QUALIFY place0 > {skip} AND place0 <= {upto}"
    )


TIES = "mid, pos, champ, gold, damage"

IDS = """
rec AS (
  SELECT puuid, mid, queue, row_number() OVER (PARTITION BY puuid ORDER BY created DESC, mid DESC) - 1 AS place FROM games),
rec420 AS (
  SELECT puuid, mid, row_number() OVER (PARTITION BY puuid ORDER BY created DESC, mid DESC) - 1 AS place FROM games WHERE queue = 420),
have AS (SELECT mid FROM m WHERE status <> 'O')
"""


def counted(rows: str) -> str:
    return (
        f"SELECT c_custkey AS puuid, c_name AS name, count(r.mid) AS total, count(h.mid) AS stored "
        f"FROM customer LEFT JOIN ({rows}) r ON c_custkey = r.puuid LEFT JOIN have h ON r.mid = h.mid GROUP BY ALL"
    )


_ELO = "SELECT c_custkey AS puuid FROM customer WHERE c_mktsegment IN (" + ", ".join(f"'{t}'" for t in HIGH_LEAGUES) + ")"


def _compare(stats: str, laning: bool, more: str = "", series: str = "") -> str:
    h, v = "h.", "v."
    cs = f"CASE WHEN hcs > 0 AND vcs > 0 THEN (hcs - vcs) / vcs * 100 END"
    dpm = f"CASE WHEN hdpm > 0 AND vdpm > 0 THEN (hdpm - vdpm) / vdpm * 100 END"
    t = TEXTS

    def word(d: str, limit: int, hero: str, villain: str) -> str:
        hb, ha = t[hero]
        vb, va = t[villain]
        return (
            f"CASE WHEN {d} > {limit} THEN '{hb}' || {number(d)} || '{ha}' "
            f"WHEN {d} < -{limit} THEN '{vb}' || {number('-(' + d + ')')} || '{va}' END"
        )

    def tip(d: str, limit: int, text: str) -> str:
        return f"CASE WHEN {d} < -{limit} THEN '{t[text]}' END"

    rules = [
        (f"({cs})", 10, "hero_cs", "villain_cs", "farm"),
        ("(hcsd - vcsd)", 3, "hero_csd", "villain_csd", "lane"),
        ("(hvis - vvis)", 5, "hero_vision", "villain_vision", "wards"),
        (f"({dpm})", 10, "hero_dpm", "villain_dpm", "fights"),
    ]
    ahead = ", ".join(word(d, n, a, b) for d, n, a, b, _ in rules)
    tips = ", ".join(tip(d, n, x) for d, n, _, _, x in rules)
    ahead += f", CASE WHEN vkda > hkda AND vwr < hwr THEN '{t['better_kda']}' END"
    tips += f", CASE WHEN hkda > vkda AND hwr < vwr THEN '{t['convert']}' END"
    csd = "{0}csd" if laning else "0e0"
    cols = ", ".join(
        f"{s}.name AS {s}name, {s}.games AS {s}games, {rnd(s + '.wr', 2)} AS {s}wr, {rnd(s + '.kda', 2)} AS {s}kda, "
        f"{rnd(s + '.cspm', 1)} AS {s}cs, {rnd(s + '.dpm', 1)} AS {s}dpm, {rnd(s + '.vision', 1)} AS {s}vis, "
        f"{rnd(csd.format(s + '.'), 1)} AS {s}csd, {s}.solok AS {s}solok, {s}.solod AS {s}solod"
        for s in ("h", "v")
    )
    return f"""
    , who AS (SELECT s.*, usr.name FROM ({stats}) s JOIN usr USING (puuid)),
    duo AS (SELECT hero, villain, {cols} FROM pairs JOIN who h ON hero = h.puuid JOIN who v ON villain = v.puuid)
    SELECT hero, villain, hname AS "heroGameName", vname AS "villainGameName", hgames AS "heroGamesPlayed", vgames AS "villainGamesPlayed",
      hwr AS "heroWinRate", vwr AS "villainWinRate", hkda AS "heroAvgKda", vkda AS "villainAvgKda", hcs AS "heroAvgCspm",
      vcs AS "villainAvgCspm", hdpm AS "heroAvgDpm", vdpm AS "villainAvgDpm", hvis AS "heroAvgVisionScore",
      hcsd AS "heroAvgCsd15", vcsd AS "villainAvgCsd15", hsolok AS "heroSoloKills15", vsolod AS "villainSoloDeaths15",{more}
      CASE WHEN hwr >= vwr THEN 'hero' ELSE 'villain' END AS winner,
      array_to_string([x FOR x IN [{ahead}] IF x IS NOT NULL], ' | ') AS advantages,
      array_to_string([x FOR x IN [{tips}] IF x IS NOT NULL], ' | ') AS recommendations
    FROM duo{series}"""


_AVG = """
sample AS (SELECT * FROM g WHERE queue = 420),
avg_cs AS (
  SELECT supp AS puuid, minute, floor(sum(minute * (4 + qty % 5) + part % 3)::DOUBLE / count(*) + 0.5) AS value
  FROM (SELECT *, unnest(range(len)) AS minute FROM sample) GROUP BY supp, minute)
"""

_GOLD = """
gt AS (
  SELECT mid, minute, sum(CASE WHEN team = 100 THEN v ELSE 0 END)::BIGINT AS blue, sum(CASE WHEN team = 200 THEN v ELSE 0 END)::BIGINT AS red FROM (
    SELECT mid, team, minute, 500 + minute * (200 + part % 300) + (supp * minute * minute) % 53 * 60 AS v
    FROM (SELECT *, unnest(range(len)) AS minute FROM p)) GROUP BY mid, minute)
"""

BODIES: dict[str, tuple[list[str], str]] = {}


def sql(name: str, body: str, *ctes: str) -> None:
    BODIES[name] = (list(ctes), body)


# ---- match documents

sql("match_rows", """
SELECT 'EV_' || block AS "matchId", t AS "gameCreation", 1500 + k % 1200 AS "gameDuration", 'CLASSIC' AS "gameMode",
  CASE WHEN block % 5 = 0 THEN 440 ELSE 420 END AS "queueId", '15.' || (1 + block % 12) || '.712.1836' AS "gameVersion",
  11 AS "mapId", '15.' || (1 + block % 12) AS patch FROM blk""")

_BANS = """
db AS (
  SELECT 'EV_' || block AS mid, block, k, team, [x FOR x IN [(block * 7 + team) % 50, -1, k % 50] IF x > 0 AND (team = 100 OR block % 6 <> 0)] AS bans
  FROM blk, (VALUES (100), (200)) v(team) WHERE block % 13 <> 0)
"""
sql("team_rows", """
SELECT mid AS "matchId", team AS "teamId", (team = 100) = (k % 2 = 0) AS win, array_to_string(bans, ',') AS bans,
  k % 2 = 0 AS "baronFirst", (k + 5 * team) % 4 AS "towerKills" FROM db""", _BANS)
sql("match_bans", 'SELECT mid AS "matchId", unnest(bans) AS "championId" FROM db', _BANS)
sql("participant_rows", """
SELECT mid AS "matchId", n - 1 AS pos, puuid, 'Summoner ' || n AS "summonerName", champ AS "championId", 'Champion ' || champ AS "championName",
  team AS "teamId", role, CASE WHEN n = 3 THEN ind ELSE lane0 || '_LANE' END AS lane, win, (k + n) % 15 AS kills, (k * n) % 9 AS deaths,
  (v + n) % 20 AS assists, ((k + n) % 15 + (v + n) % 20) / greatest((k * n) % 9, 1)::DOUBLE AS kda, 8000 + v * n % 7000 AS "goldEarned",
  5000 + v * n * 3 % 30000 AS "totalDamage", 4000 + k * n % 20000 AS "damageTaken", CASE WHEN n = 10 THEN 0 ELSE (k + n * 5) % 80 END AS "visionScore",
  5002 + n AS offense, (k % 10) / 4e0 AS "kdaRatio", 'allInPings=' || n || ',commandPings=' || (v % 6) || ',onMyWayPings=' || ((k + n) % 9) AS pings,
  '4,' || (11 + n % 4) AS spells FROM doc""")
sql("slim_participants", """
SELECT mid AS "matchId", ind AS position, puuid, champ AS "championId", team AS "teamId", win, (k + n) % 15 AS kills,
  5000 + v * n * 3 % 30000 AS "totalDamageDealtToChampions", n * 20 + k % 7 AS "totalMinionsKilled", n + v % 5 AS "neutralMinionsKilled" FROM doc""")
sql("match_outcomes", """
SELECT 'EV_' || block AS "matchId", '15.' || (1 + block % 12) AS patch, 1500 + k % 1200 AS "gameDuration",
  CASE WHEN k % 2 = 0 THEN 100 ELSE 200 END AS "winningTeamId" FROM blk""")
sql("lane_pairs", """
SELECT b.mid AS "matchId", b.ind AS position, b.champ AS "champion1Id", 'Champion ' || b.champ AS "champion1Name", r.champ AS "champion2Id",
  'Champion ' || r.champ AS "champion2Name", CASE WHEN b.win THEN b.champ ELSE r.champ END AS "winnerId"
FROM doc b JOIN doc r ON b.mid = r.mid AND b.ind = r.ind AND b.team = 100 AND r.team = 200 WHERE b.ind <> ''""")
sql("participant_map", 'SELECT mid AS "matchId", n AS "participantId", puuid FROM ids')
sql("unmatched_participants", """SELECT mid AS "matchId", n AS "participantId", puuid FROM ids
WHERE NOT EXISTS (SELECT 1 FROM doc WHERE doc.mid = ids.mid AND doc.puuid = ids.puuid)""")

# ---- timelines

sql("timeline_series", 'SELECT mid AS "matchId", puuid, minute, gold, xp, cs, damage FROM ser')
sql("timeline_paths", """
SELECT mid AS "matchId", puuid, row_number() OVER (PARTITION BY mid, n ORDER BY i) - 1 AS place, CASE WHEN u % 6 <> 0 THEN v * n % 15000 END AS x,
  CASE WHEN u % 6 <> 0 THEN n * 100 + i END AS y, i * 40000 AS time FROM fr""")
sql("timeline_items", f"""
SELECT mid AS "matchId", puuid, place, item AS "itemId", i * 40000 + 500 AS timestamp, {rnd('(i * 40000 + 500) / 6e4', 1)} AS minute, type
FROM itm JOIN ids USING (block, n)""")
sql("skill_orders", """
SELECT mid AS "matchId", puuid, coalesce(string_agg(CASE k % 5 WHEN 0 THEN 'Q' WHEN 1 THEN 'W' WHEN 2 THEN 'E' WHEN 3 THEN 'R' WHEN 4 THEN '?' END, '' ORDER BY i), '') AS skills
FROM ids LEFT JOIN (SELECT * FROM ev WHERE kind = 'signup' AND k % 2 = 0) e ON ids.block = e.block AND n = u % 10 + 1 GROUP BY mid, puuid""")
sql("solo_fights", """
SELECT mid AS "matchId", puuid,
  count(*) FILTER (kind = 'error' AND k % 5 = 4 AND u % 2 = 0 AND u % 11 = n AND i * 40000 + 500 < 900000) AS "soloKills15",
  count(*) FILTER (kind = 'click' AND k % 10 + 1 = n AND k % 3 <> 0 AND i * 40000 + 500 < 900000) AS "soloDeaths15"
FROM ids JOIN ev USING (block) GROUP BY mid, puuid""")
sql("timeline_objectives", 'SELECT mid AS "matchId", place, type, sub AS "subType", team AS "teamId", ts AS timestamp, killer AS "killerId" FROM obj')
sql("event_classes", """
SELECT type, type = 'CHAMPION_KILL' AS "isKill", type IN ('WARD_PLACED', 'WARD_KILL') AS "isWard",
  type IN ('ITEM_PURCHASED', 'ITEM_SOLD', 'ITEM_UNDO') AS "isItem", type = 'ELITE_MONSTER_KILL' AS "isElite",
  type <> 'CHAMPION_SPECIAL_KILL' AS "isUsed", count(*) AS events
FROM (SELECT CASE kind WHEN 'click' THEN 'CHAMPION_KILL' WHEN 'view' THEN 'WARD_PLACED' WHEN 'purchase' THEN 'ITEM_PURCHASED'
    WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'SKILL_LEVEL_UP' ELSE 'ITEM_UNDO' END
    ELSE ['ITEM_SOLD','ELITE_MONSTER_KILL','BUILDING_KILL','WARD_KILL','CHAMPION_SPECIAL_KILL'][k % 5 + 1] END AS type FROM ev)
GROUP BY type""")
sql("ingested_participants", """
SELECT doc.mid AS "matchId", doc.puuid, doc.role, coalesce(s.minutes, 0) AS minutes, coalesce(s.last_cs, 0) AS "lastCs", coalesce(s.gold15, 0) AS gold15,
  coalesce(s.xp15, 0) AS xp15, coalesce(s.cs15, 0) AS cs15, coalesce(k.n, 0) AS skills, coalesce(t.n, 0) AS items, coalesce(f.items, '') AS "finalBuild"
FROM doc LEFT JOIN ids ON doc.mid = ids.mid AND doc.puuid = ids.puuid
LEFT JOIN (SELECT mid, n, count(*) AS minutes, max_by(cs, minute) AS last_cs, max(gold) FILTER (minute = 15) AS gold15,
  max(xp) FILTER (minute = 15) AS xp15, max(cs) FILTER (minute = 15) AS cs15 FROM ser GROUP BY mid, n) s ON s.mid = ids.mid AND s.n = ids.n
LEFT JOIN (SELECT block, u % 10 + 1 AS pid, count(*) AS n FROM ev WHERE kind = 'signup' AND k % 2 = 0 GROUP BY ALL) k ON k.block = ids.block AND k.pid = ids.n
LEFT JOIN (SELECT block, n AS pid, count(*) AS n FROM itm GROUP BY ALL) t ON t.block = ids.block AND t.pid = ids.n
LEFT JOIN final_items f ON f.block = ids.block AND f.n = ids.n""")
sql("match_events", """
, here AS (SELECT ids.block, ids.n, doc.mid, doc.puuid, doc.champ FROM ids JOIN doc ON doc.mid = ids.mid AND doc.puuid = ids.puuid),
e AS (SELECT *, i * 40000 + 500 AS ts FROM ev)
SELECT mid AS "matchId", 'kill' AS kind, puuid, champ AS "championId", v AS x, i AS y, ts AS timestamp, ts // 60000 AS minute, NULL AS type,
  NULL AS "subType", NULL AS "teamId", NULL AS "killerId" FROM here JOIN e ON here.block = e.block AND e.kind = 'click' AND u % 11 = n
UNION ALL SELECT mid, 'death', puuid, champ, v, i, ts, ts // 60000, NULL, NULL, NULL, NULL FROM here JOIN e ON here.block = e.block AND e.kind = 'click' AND k % 10 + 1 = n
UNION ALL SELECT mid, 'ward', puuid, champ, 0, 0, ts, ts // 60000, CASE WHEN k % 2 = 0 THEN 'YELLOW_TRINKET' ELSE 'CONTROL_WARD' END, NULL, NULL, NULL
  FROM here JOIN e ON here.block = e.block AND e.kind = 'view' AND u % 11 = n
UNION ALL SELECT mid, 'objective', NULL, NULL, NULL, NULL, ts, ts // 60000, type, sub, team, killer FROM obj""")
sql("match_builds", """
SELECT doc.mid AS "matchId", doc.puuid, doc.champ AS "championId", 'Champion ' || doc.champ AS "championName", coalesce(t.n, 0) AS items, coalesce(f.items, '') AS "finalBuild"
FROM doc LEFT JOIN ids ON doc.mid = ids.mid AND doc.puuid = ids.puuid
LEFT JOIN (SELECT block, n AS pid, count(*) AS n FROM itm GROUP BY ALL) t ON t.block = ids.block AND t.pid = ids.n
LEFT JOIN final_items f ON f.block = ids.block AND f.n = ids.n""")
sql("match_detail", f"""
SELECT d.mid AS "matchId", d.t::VARCHAR AS "gameCreation", '15.' || (1 + block % 12) AS patch, coalesce(b.n, 0) AS teams, p.n AS participants,
  coalesce(b.content, '') AS "teamContent", p.content
FROM (SELECT mid, any_value(block) AS block, any_value(t) AS t FROM doc GROUP BY mid) d
JOIN (SELECT "matchId" AS mid, count(*) AS n, string_agg(concat_ws('|', pos, puuid, "summonerName", "championId", "championName", "teamId", role, lane, win, kills, deaths,
  assists, round(kda * 1000)::BIGINT, "goldEarned", "totalDamage", "damageTaken", "visionScore", offense, "kdaRatio"::DECIMAL(9,2), pings, spells), chr(10) ORDER BY pos) AS content
  FROM ({BODIES["participant_rows"][1]}) GROUP BY 1) p USING (mid)
LEFT JOIN (SELECT "matchId" AS mid, count(*) AS n, string_agg(concat_ws('|', "teamId", win, bans, "baronFirst", "towerKills"), chr(10) ORDER BY "teamId") AS content
  FROM ({BODIES["team_rows"][1]}) GROUP BY 1) b USING (mid)""", _BANS)

# ---- catalog and patches

_IMG = "https://ddragon.leagueoflegends.com/cdn"
sql("champion_list", f"""
SELECT champ AS "championId", cid AS id, cname AS name, title, replace(lower(cname), ' ', '') AS "normalName",
  '{_IMG}/15.19.1/img/champion/' || cid || '.png' AS square, '{_IMG}/img/champion/loading/' || cid || '_0.jpg' AS loading,
  '{_IMG}/img/champion/splash/' || cid || '_0.jpg' AS splash FROM cat""")
sql("champion_list_of_file", f"""
SELECT row_number() OVER (ORDER BY lower(cname), champ) AS place, count(*) OVER () AS total, champ AS "championId", cid AS id, cname AS name, title,
  '{_IMG}/15.19.1/img/champion/' || cid || '.png' AS square FROM cat""")
sql("league_entries", """
SELECT c_custkey::VARCHAR AS puuid, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ' OWN' ELSE c_mktsegment END AS tier, 'RANKED_SOLO_5x5' AS "queueType",
  'I' AS rank, floor(abs(c_acctbal) / 10)::BIGINT AS "leaguePoints", c_custkey % 70 AS wins, c_custkey % 60 AS losses FROM customer""")
sql("listed_match_ids", 'SELECT puuid::VARCHAR AS puuid, place, mid::VARCHAR AS "matchId" FROM rec WHERE place BETWEEN 2 AND 6', IDS)
sql("patch_list", """
SELECT row_number() OVER (ORDER BY y DESC, q DESC) - 1 AS place, patch, patch || '.1' AS "fullVersion",
  row_number() OVER (ORDER BY y DESC, q DESC) = 1 AS current FROM (SELECT DISTINCT y, q, patch FROM m)""")
sql("previous_patches", """
SELECT patch, CASE WHEN q > 1 THEN (y - 1985) || '.' || (q - 1) ELSE (y - 1986) || '.23' END AS previous,
  CASE WHEN q > 1 THEN (y - 1985) || '.0' || (q - 1) ELSE (y - 1986) || '.23' END AS "previousPadded" FROM (SELECT DISTINCT y, q, patch FROM m)""")

# ---- ingest: the documents' own games

_DOCS = f"""
ls AS (SELECT mid, puuid, max_by(cs, minute) AS last_cs, max(gold) FILTER (minute = 15) AS gold15, max(xp) FILTER (minute = 15) AS xp15,
  max(cs) FILTER (minute = 15) AS cs15 FROM ser GROUP BY mid, puuid),
dg0 AS (
  SELECT doc.*, '15.' || (1 + block % 12) AS patch, CASE WHEN block % 5 = 0 THEN 440 ELSE 420 END AS queue, 1500 + k % 1200 AS duration,
    ((k + n) % 15 + (v + n) % 20) / greatest((k * n) % 9, 1)::DOUBLE AS kda, coalesce(ls.last_cs, 0) AS last_cs,
    coalesce(gold15, 0) AS gold15, coalesce(xp15, 0) AS xp15, coalesce(cs15, 0) AS cs15
  FROM doc LEFT JOIN ls ON doc.mid = ls.mid AND doc.puuid = ls.puuid),
dg AS (SELECT *, (5000 + v * n * 3 % 30000) / (duration / 6e1) AS dpm, last_cs / (duration / 6e1) AS cspm FROM dg0),
dopp AS (
  SELECT a.mid, a.n, b.gold15 AS ogold, b.xp15 AS oxp, b.cs15 AS ocs FROM dg a JOIN dg b ON a.mid = b.mid AND a.role = b.role AND a.team <> b.team
  QUALIFY row_number() OVER (PARTITION BY a.mid, a.n ORDER BY b.n) = 1)
"""
sql("streaming_ingest", f"""
, x AS (SELECT patch, queue, count(DISTINCT mid) AS n FROM dg GROUP BY ALL),
b AS (SELECT champ, patch, queue, count(DISTINCT mid) AS n FROM (SELECT mid, unnest(bans) AS champ, '15.' || (1 + block % 12) AS patch,
  CASE WHEN block % 5 = 0 THEN 440 ELSE 420 END AS queue FROM db) GROUP BY ALL),
s AS (SELECT champ, patch, queue, count(*) AS games, sum(win::INT) AS wins, {pct('sum(win::INT)', 'count(*)')} AS wr, {mean('kda')} AS kda, {mean('dpm')} AS dpm,
  {mean('cspm')} AS cspm FROM dg GROUP BY champ, patch, queue)
SELECT champ AS "championId", patch, queue AS "queueId", games AS "gamesPlayed", wins, wr AS "winRate", kda, dpm, cspm, {pct('coalesce(b.n, 0)', 'x.n')} AS "banRate",
  {pct('games', 'x.n')} AS "pickRate" FROM s JOIN x USING (patch, queue) LEFT JOIN b USING (champ, patch, queue)""", _DOCS, _BANS)
sql("batch_ingest", f"""
, e AS (SELECT dg.* EXCLUDE (patch), l.patch, dopp.* EXCLUDE (mid, n) FROM dg LEFT JOIN dopp USING (mid, n), LATERAL (SELECT unnest([dg.patch, 'ALL']) AS patch) l)
SELECT puuid, champ AS "championId", patch, queue AS "queueId", count(*) AS "gamesPlayed", sum(win::INT) AS wins, {rnd(mean('kda'), 2)} AS "avgKda",
  {rnd(mean('cspm'), 2)} AS "avgCspm", {rnd('coalesce(avg(cs15 - ocs), 0e0)', 2)} AS "avgCsd15", {rnd('coalesce(avg(gold15 - ogold), 0e0)', 2)} AS "avgGd15",
  {rnd('coalesce(avg(xp15 - oxp), 0e0)', 2)} AS "avgXpd15", max(t) AS "lastPlayedAt" FROM e GROUP BY puuid, champ, patch, queue""", _DOCS)

sql("ingest_after_backfill", """
SELECT 'EV_' || block AS "matchId", '15.' || (1 + block % 12) AS patch, CASE WHEN block % 5 = 0 THEN 440 ELSE 420 END AS "queueId", t AS "gameCreation" FROM blk""")
sql("ingest_repeated", """
SELECT '15.' || (1 + block % 12) AS patch, CASE WHEN block % 5 = 0 THEN 440 ELSE 420 END AS "queueId", count(*) AS matches, 10 * count(*) AS participants,
  sum(t) AS created FROM blk GROUP BY ALL""")
sql("stream_repeats", """
, n AS (SELECT count(*) FILTER (block % 3 = 0) AS a, count(*) FILTER (block % 3 = 1) AS b, count(*) FILTER (block % 3 = 2) AS c FROM blk)
SELECT 1 AS wave, a AS came, a AS stored FROM n UNION ALL SELECT 2, b, b FROM n UNION ALL SELECT 3, c, c FROM n UNION ALL SELECT 4, a + b, 0 FROM n""")
sql("reads_across_commits", """
SELECT commit, '15.' || (1 + block % 12) AS patch, count(*) AS matches, 10 * count(*) AS participants
FROM blk, range(4) commits(commit) WHERE block % 4 <= commit GROUP BY ALL""")
sql("rejected_records", """
SELECT CASE WHEN block % 4 <> 3 THEN 'EV_' || block END AS "matchId",
  ['stored', 'ids differ', 'timeline without an id', 'match without an id'][block % 4 + 1] AS reason FROM blk""")

# ---- champions

sql("champion_stats", """
SELECT champ AS "championId", patch, queue AS "queueId", games AS "gamesPlayed", wins, games - wins AS losses, wr AS "winRate", kda, dpm, gpm, cspm,
  br AS "banRate", pr AS "pickRate" FROM st""", CHAMPIONS)
sql("champion_totals", """
SELECT s.patch, s.champ AS "championId", s.n AS "gamesPlayed", s.k AS "totalKills", s.d AS "totalDeaths", s.a AS "totalAssists", s.cs AS "totalCs",
  s.damage AS "totalDamage", s.gold AS "totalGold", s.duration AS "totalDuration", coalesce(b.n, 0) AS "totalBans"
FROM (SELECT patch, champ, count(*) AS n, sum(k) AS k, sum(dd) AS d, sum(a) AS a, sum(last_cs) AS cs, sum(damage) AS damage, sum(gold) AS gold,
  sum(duration) AS duration FROM g GROUP BY patch, champ) s
LEFT JOIN (SELECT patch, champ, count(*) AS n FROM bans GROUP BY patch, champ) b USING (patch, champ)""")
sql("primary_roles", """
SELECT champ AS "championId", patch, role AS "primaryRole", n AS "roleGames" FROM (SELECT champ, patch, role, count(*) AS n FROM g GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY champ, patch ORDER BY n DESC, role) = 1""")
sql("matchups", f"""
, last AS (SELECT mid, role, team, champ, win FROM p QUALIFY row_number() OVER (PARTITION BY mid, role, team ORDER BY pos DESC, champ DESC, win DESC) = 1),
pr AS (SELECT m.patch, b.role, least(b.champ, r.champ) AS c1, greatest(b.champ, r.champ) AS c2, CASE WHEN b.champ <= r.champ THEN b.win ELSE r.win END AS w
  FROM last b JOIN last r ON b.mid = r.mid AND b.role = r.role AND b.team = 100 AND r.team = 200 JOIN m ON m.mid = b.mid)
SELECT patch, role, c1 AS "championId1", c2 AS "championId2", count(*) AS "gamesPlayed", sum(w::INT) AS "champion1Wins", count(*) - sum(w::INT) AS "champion2Wins",
  {rnd(pct('sum(w::INT)', 'count(*)'), 2)} AS "winRate1", {rnd(pct('count(*) - sum(w::INT)', 'count(*)'), 2)} AS "winRate2" FROM pr GROUP BY patch, role, c1, c2""")
sql("tier_list", f"""
SELECT patch, queue AS "queueId", champ AS "championId", cname AS "championName", '{_IMG}/15.19.1/img/champion/' || cid || '.png' AS square,
  games AS "gamesPlayed", wins, games - wins AS losses, {_RATE_COLUMNS}, tier, rank, {rnd('score', 4)} AS score
FROM ({ranked('(SELECT * FROM tier JOIN cat USING (champ))')})""", CHAMPIONS)
sql("tier_list_page", f"""
SELECT champ AS "championId", cname AS "championName", {_RATE_COLUMNS}, tier, rank, count(*) OVER () AS total
FROM ({ranked(f"(SELECT * FROM tier JOIN cat USING (champ) WHERE patch = '{PATCH}' AND queue = 420)")}) ORDER BY "pickRate", champ LIMIT 10 OFFSET 10""", CHAMPIONS)
sql("champion_detail", f"""
SELECT patch, champ AS "championId", cname AS "championName", games AS "gamesPlayed", {rnd('wr', 2)} AS "winRate", tier, rank
FROM ({ranked('(SELECT * FROM tier WHERE queue = 420)')}) JOIN cat USING (champ) WHERE cname = '{CHAMPION_NAME}'""", CHAMPIONS)
sql("processed_matches", f"""
SELECT count(*) AS count, NULL AS patch, NULL AS message FROM m UNION ALL SELECT count(*), '{PATCH}', NULL FROM m WHERE patch = '{PATCH}'
UNION ALL SELECT count(*), '13', NULL FROM m WHERE patch || '.' LIKE '13.%'
UNION ALL SELECT count(*), '99.9', 'Não há dados para o patch 99.9' FROM m WHERE patch = '99.9'""")

# ---- players

_PS = (
    'games AS "gamesPlayed", wins, games - wins AS losses, wr AS "winRate", kda AS "avgKda", dpm AS "avgDpm", gpm AS "avgGpm", '
    'cspm AS "avgCspm", vision AS "avgVisionScore"'
)
sql("player_stats", f'SELECT puuid, patch, queue AS "queueId", {_PS}, last AS "lastPlayedAt" FROM ps', PLAYERS)
sql("player_champion_stats", f"""SELECT puuid, champ AS "championId", patch, queue AS "queueId", {_PS}, csd AS "avgCsd15", gd AS "avgGd15",
  xpd AS "avgXpd15", last AS "lastPlayedAt" FROM pcs""", PLAYERS)
sql("role_distribution", 'SELECT supp AS puuid, patch, queue AS "queueId", role, count(*) AS games FROM gg GROUP BY supp, patch, queue, role', PLAYERS)
sql("top_champions", f"""
SELECT puuid, patch, queue AS "queueId", place, topc.champ AS "championId", coalesce(cname, 'Champion ' || topc.champ) AS "championName",
  coalesce('{_IMG}/15.19.1/img/champion/' || cid || '.png', '') AS "imageUrl", games, wr AS "winRate" FROM topc LEFT JOIN cat USING (champ)""", PLAYERS)
sql("player_summary", f"""
SELECT puuid, {_PS}, roles, tops AS "topChampions" FROM ps
JOIN (SELECT supp AS puuid, string_agg(role || '=' || n, ',' ORDER BY role) AS roles FROM (SELECT supp, role, count(*) AS n FROM g WHERE queue = 420 GROUP BY ALL) GROUP BY supp) USING (puuid)
JOIN (SELECT puuid, string_agg(coalesce(cname, 'Champion ' || topc.champ) || '=' || games, ',' ORDER BY place) AS tops
  FROM topc LEFT JOIN cat USING (champ) WHERE patch = 'ALL' AND queue = 420 GROUP BY puuid) USING (puuid)
WHERE patch = 'ALL' AND queue = 420""", PLAYERS)
sql("player_champions", """
SELECT puuid, place, t.champ AS "championId", coalesce(cname, 'Champion ' || t.champ) AS "championName", games AS "gamesPlayed", wr AS "winRate",
  kda AS "avgKda", csd AS "avgCsd15"
FROM (SELECT *, row_number() OVER (PARTITION BY puuid ORDER BY wr DESC, champ) AS place FROM pcs WHERE patch = 'ALL' AND queue = 420 AND mids > 0 QUALIFY place <= 10) t
LEFT JOIN cat USING (champ)""", PLAYERS)


def roles_sql(where: str) -> str:
    return f"""
SELECT supp AS puuid, row_number() OVER (PARTITION BY supp ORDER BY count(*) DESC, role) AS place, role, count(*) AS "gamesPlayed", {rnd(pct('count(*)', 'sum(count(*)) OVER (PARTITION BY supp)'), 2)} AS percentage,
  sum(win::INT) AS wins, count(*) - sum(win::INT) AS losses, {rnd(pct('sum(win::INT)', 'count(*)'), 2)} AS "winRate", {rnd(mean('kda'), 2)} AS "avgKda",
  sum(count(*)) OVER (PARTITION BY supp) AS "totalGames" FROM g WHERE queue = 420 {where} GROUP BY supp, role"""


sql("player_roles", roles_sql(""))
sql("player_roles_of_patch", roles_sql(f"AND patch || '.' LIKE '{PATCH}.%'"))
sql("player_activity", """
SELECT pl.puuid, d * 24 + h + 1 AS place, d AS "dayOfWeek", h AS hour, coalesce(games, 0) AS games, coalesce(wins, 0) AS wins, coalesce(games - wins, 0) AS losses, coalesce(wr, 0e0) AS "winRate"
FROM (SELECT DISTINCT puuid FROM cells) pl, range(7) x(d), range(24) y(h) LEFT JOIN cells c ON c.puuid = pl.puuid AND c.dow = d AND c.hour = h""", CELLS)
_DAY = "['Sunday','Monday','Tuesday','Wednesday','Thursday','Friday','Saturday']"
sql("activity_insights", f"""
, days AS (SELECT puuid, dow, sum(games) AS games FROM cells GROUP BY puuid, dow QUALIFY row_number() OVER (PARTITION BY puuid ORDER BY sum(games) DESC, dow) = 1),
hrs AS (SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY puuid ORDER BY games DESC, dow, hour) = 1),
best AS (SELECT * FROM cells WHERE games >= 5 QUALIFY row_number() OVER (PARTITION BY puuid ORDER BY wr DESC, dow, hour) = 1),
worst AS (SELECT * FROM cells WHERE games >= 5 QUALIFY row_number() OVER (PARTITION BY puuid ORDER BY wr, dow, hour) = 1)
SELECT d.puuid, {_DAY}[d.dow + 1] AS "mostActiveDay", d.games AS "mostActiveDayGames", h.hour AS "mostActiveHour", h.games AS "mostActiveHourGames",
  coalesce(b.wr, 0e0) AS "peakWinRate", coalesce({_DAY}[b.dow + 1] || ' ' || b.hour || 'h', 'N/A') AS "peakWinRateTime",
  coalesce(w.wr, 0e0) AS "worstWinRate", coalesce({_DAY}[w.dow + 1] || ' ' || w.hour || 'h', 'N/A') AS "worstWinRateTime"
FROM days d JOIN hrs h USING (puuid) LEFT JOIN best b USING (puuid) LEFT JOIN worst w USING (puuid)""", CELLS)
sql("activity_days", 'SELECT puuid, dow AS "dayOfWeek", sum(games) AS games, sum(wins) AS wins FROM cells GROUP BY puuid, dow', CELLS)
sql("player_matches", history_sql("hist", f"created DESC, {TIES}", 20, 20), HIST)
sql("player_matches_filtered", history_sql(
    f"(SELECT * FROM hist WHERE role = 'MIDDLE' AND win AND created BETWEEN {FROM_MS} AND {TO_MS})", f"kda DESC, {TIES}", 0, 10), HIST)
for _name, _key in (("kills", "k"), ("damage", "damage")):
    sql(f"player_matches_by_{_name}", history_sql("(SELECT * FROM hist WHERE champ = 0)", f"{_key} DESC, {TIES}", 0, 15), HIST)
sql("player_matches_after", f"""
, cur AS (SELECT puuid, mid, created FROM hist WHERE puuid % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY puuid ORDER BY created DESC, {TIES}) = 5),
behind AS (SELECT hist.* FROM hist LEFT JOIN cur USING (puuid) WHERE cur.mid IS NULL OR hist.created < cur.created OR (hist.created = cur.created AND hist.mid > cur.mid))
{history_sql('behind', f'created DESC, {TIES}', 0, 10)}""", HIST)
sql("history_counts", f"SELECT supp AS puuid, count(*) AS matches FROM g WHERE queue = 420 AND champ = {CHAMPION} AND NOT win GROUP BY supp")
sql("player_profile", """
SELECT s_suppkey AS puuid, s_name AS "gameName", 'BR1' AS "tagLine", n_name AS region, s_suppkey % 29 AS "profileIconId", 30 + s_suppkey % 400 AS "summonerLevel",
  CASE WHEN s_acctbal > 5000 THEN 'GOLD' WHEN s_acctbal > 0 THEN 'SILVER' END AS tier, floor(abs(s_acctbal) / 100) AS "leaguePoints",
  CASE WHEN s_acctbal > 0 THEN ['I', 'II', 'III', 'IV'][s_suppkey % 4 + 1] END AS rank, s_suppkey % 100 AS "rankedWins", s_suppkey % 90 AS "rankedLosses",
  1700000000 + s_suppkey AS "lastUpdated", 1600000000 + s_suppkey AS "createdAt"
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")
sql("player_upsert", """
, w AS (SELECT *, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) * 1000000 + o_orderkey % 1000000 AS ts FROM orders),
l AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY ts DESC) = 1),
f AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY ts) = 1)
SELECT l.o_custkey AS puuid, 'Name' || (l.o_orderkey % 7) AS "gameName", f.o_orderpriority AS region, l.o_orderkey % 29 AS "profileIconId",
  30 + l.o_orderkey % 400 AS "summonerLevel", 'S' || l.o_orderkey AS "summonerId", l.o_orderstatus AS tier, floor(l.o_totalprice / 1000) AS "leaguePoints",
  l.o_orderkey % 100 AS "rankedWins", l.o_orderkey % 90 AS "rankedLosses", l.ts AS "lastUpdated", f.ts AS "createdAt" FROM l JOIN f USING (o_custkey)""")

# ---- matches

sql("gold_timeline", 'SELECT mid AS "matchId", minute, blue AS "blueTeam", red AS "redTeam", blue - red AS difference FROM gt', _GOLD)
sql("gold_insights", """
, d AS (SELECT mid, minute, blue - red AS diff, lag(blue - red) OVER (PARTITION BY mid ORDER BY minute) AS prev FROM gt),
fin AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY mid ORDER BY minute DESC) = 1),
lead AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY mid ORDER BY abs(diff) DESC, minute) = 1),
thr AS (SELECT * FROM d WHERE abs(diff - prev) > 3000 QUALIFY row_number() OVER (PARTITION BY mid ORDER BY minute) = 1)
SELECT m.mid AS "matchId", CASE WHEN fin.diff > 0 THEN 'blueTeam' ELSE 'redTeam' END AS winner, lead.minute AS "maxAdvantageMinute",
  CASE WHEN lead.diff > 0 THEN 'blueTeam' WHEN lead.diff IS NOT NULL THEN 'redTeam' END AS "maxAdvantageTeam", abs(lead.diff) AS "maxAdvantage",
  thr.minute AS "throwMinute", thr.prev AS "throwBefore", thr.diff AS "throwAfter", abs(thr.diff - thr.prev) AS "throwSwing"
FROM m LEFT JOIN fin USING (mid) LEFT JOIN lead USING (mid) LEFT JOIN thr USING (mid)""", _GOLD)
sql("objective_events", """
SELECT mid AS "matchId", 'DRAGON' AS type, NULL AS "subType", team AS "teamId", mid % 31 * 30000 + team * 7 AS timestamp, (mid % 31 * 30000 + team * 7) // 60000 AS minute,
  cust % 10 + 1 AS "killerId" FROM m, (VALUES (100), (200)) v(team)
UNION ALL SELECT mid, 'TOWER', 'MID_LANE', 300 - team, mid % 31 * 60000 + team, (mid % 31 * 60000 + team) // 60000, mid % 10 + 1 FROM m, (VALUES (100), (200)) v(team)""")


def _metrics(prefix: str, damage: str, gold: str, cs: str, vision: str, taken: str) -> str:
    pm = lambda c, d: rnd(f"({c}) / (duration / 6e1)", d)
    return (
        f"{pm(damage, 1)} AS {prefix}dpm, {pm(gold, 1)} AS {prefix}gpm, {pm(cs, 1)} AS {prefix}cspm, "
        f"{pm(vision, 2)} AS {prefix}vis, {pm(taken, 1)} AS {prefix}taken"
    )


def _share(n: str) -> str:
    return f"CASE WHEN o{n} = 0 THEN 0e0 ELSE {rnd(f'(m{n} - o{n}) / nullif(o{n}, 0) * 1e2', 1)} END"


# Same side's first participant by place, player, champion, kda, then rounded metrics: ties beyond the player do not occur.
sql("match_performance", f"""
, x AS (SELECT g.mid, g.supp, g.pos, g.champ, g.role, g.kda, osupp, ochamp, okda, {_metrics('m', 'g.damage', 'g.gold', 'g.last_cs', 'g.vision', 'g.taken')},
  {_metrics('o', 'odamage', 'ogolde', 'olast', 'ovision', 'otaken')} FROM g LEFT JOIN opp USING (mid, role, team))
SELECT mid AS "matchId", supp AS puuid, pos, champ AS "championId", role, kda, mdpm AS dpm, mgpm AS gpm, mcspm AS cspm, mvis AS "visionScorePerMin",
  mtaken AS "damageTakenPerMin", osupp AS "opponentPuuid", ochamp AS "opponentChampionId", okda AS "opponentKda", odpm AS "opponentDpm", ogpm AS "opponentGpm",
  ocspm AS "opponentCspm", {rnd('mdpm - odpm', 1)} AS "dpmAdvantage", {_share('dpm')} AS "dpmAdvantagePercent", {rnd('mgpm - ogpm', 1)} AS "gpmAdvantage",
  {_share('gpm')} AS "gpmAdvantagePercent", {rnd('mcspm - ocspm', 1)} AS "cspmAdvantage", {_share('cspm')} AS "cspmAdvantagePercent",
  {rnd('mvis - ovis', 2)} AS "visionAdvantage", {rnd('otaken - mtaken', 1)} AS survivability FROM x""", PLAYERS)

# ---- comparison

sql("compare_players", _compare("SELECT * FROM ps WHERE patch = 'ALL' AND queue = 420", False), PLAYERS)
sql("compare_players_champion", _compare(f"SELECT * FROM pcs WHERE patch = 'ALL' AND queue = 420 AND champ = {CHAMPION}", True), PLAYERS)
_SERIES = """
series AS (
  SELECT puuid, string_agg(cs::BIGINT::VARCHAR, ',' ORDER BY minute) AS cs, string_agg(gold::BIGINT::VARCHAR, ',' ORDER BY minute) AS gold FROM (
    SELECT supp AS puuid, minute, floor(sum(minute * (4 + qty % 5) + part % 3)::DOUBLE / count(*) + 0.5) AS cs,
      floor(sum(500 + minute * (200 + part % 300) + (supp * minute * minute) % 53 * 60)::DOUBLE / count(*) + 0.5) AS gold
    FROM (SELECT *, unnest(range(len)) AS minute FROM g WHERE queue = 420 AND champ = CHAMP) GROUP BY supp, minute) GROUP BY puuid)
""".replace("CHAMP", str(CHAMPION))
sql("comparison", _compare(
    f"SELECT * FROM pcs WHERE patch = 'ALL' AND queue = 420 AND champ = {CHAMPION}", True,
    ' hs.cs AS "heroCs", vs.cs AS "villainCs", hs.gold AS "heroGold", vs.gold AS "villainGold",',
    " LEFT JOIN series hs ON hs.puuid = hero LEFT JOIN series vs ON vs.puuid = villain"), PLAYERS, _SERIES)
sql("compare_timelines", """
SELECT hero, villain, 'hero' AS side, minute, value FROM pairs JOIN avg_cs ON hero = puuid
UNION ALL SELECT hero, villain, 'villain', minute, value FROM pairs JOIN avg_cs ON villain = puuid""", _AVG)
sql("average_gold", """
SELECT supp AS puuid, minute, floor(sum(500 + minute * (200 + part % 300) + (supp * minute * minute) % 53 * 60)::DOUBLE / count(*) + 0.5) AS value
FROM (SELECT *, unnest(range(len)) AS minute FROM sample) GROUP BY supp, minute""", _AVG)

# ---- collection

sql("high_elo_players", _ELO)
sql("recent_match_ids", 'SELECT puuid, place, mid AS "matchId" FROM rec420 WHERE place BETWEEN 3 AND 7', IDS)
sql("new_match_ids", 'SELECT puuid, place, mid AS "matchId" FROM rec WHERE place < 20 AND mid NOT IN (SELECT mid FROM have)', IDS)
sql("existing_match_ids", 'SELECT puuid, place, mid AS "matchId" FROM rec WHERE place < 20 AND mid IN (SELECT mid FROM have)', IDS)
sql("collect_new_matches", f"""
, elo AS ({_ELO}), f AS (SELECT mid, mid IN (SELECT mid FROM have) AS known FROM rec WHERE place < 20 AND puuid IN (SELECT puuid FROM elo))
SELECT (SELECT count(*) FROM elo) AS "playersFound", count(*) AS "matchesFound", count(DISTINCT mid) FILTER (NOT known) AS "matchesEnqueued",
  count(*) - count(DISTINCT mid) FILTER (NOT known) AS "duplicatesSkipped" FROM f""", IDS)
sql("work_list", """
SELECT mid AS "matchId", priority, row_number() OVER (ORDER BY priority DESC, created DESC, mid) - 1 AS place FROM (
  SELECT mid, max(priority) AS priority FROM (
    SELECT mid, 10 AS priority FROM rec WHERE place < 3 UNION ALL SELECT mid, 5 FROM rec420 WHERE place < 100 UNION ALL SELECT mid, 1 FROM rec WHERE place < 20)
  WHERE mid NOT IN (SELECT mid FROM have) GROUP BY mid) JOIN m USING (mid)""", IDS)
sql("ranked_entries", """
SELECT c_custkey AS puuid, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS tier, CASE WHEN c_acctbal > 0 THEN 'II' END AS rank,
  CASE WHEN c_acctbal > 0 THEN floor(abs(c_acctbal) / 100) END AS "leaguePoints", CASE WHEN c_acctbal > 0 THEN c_custkey % 100 END AS "rankedWins",
  CASE WHEN c_acctbal > 0 THEN c_custkey % 90 END AS "rankedLosses" FROM customer""")
sql("search_players", f"""
SELECT n.puuid, n.name AS "gameName", CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS tier, CASE WHEN c_acctbal > 0 THEN floor(abs(c_acctbal) / 100) END AS "leaguePoints",
  total - stored AS "matchesEnqueued" FROM ({counted('SELECT * FROM rec WHERE place < 20')}) n JOIN customer ON n.puuid = c_custkey""", IDS)
sql("start_sync", f"""
SELECT puuid, CASE WHEN total = stored THEN 'DONE' ELSE 'SYNCING' END AS status, total - stored AS "matchesEnqueued", total AS "matchesTotal", stored AS "matchesAlreadyInDb",
  CASE WHEN total = 0 THEN 'No ranked matches found in Riot API' WHEN total = stored THEN 'All matches already in database'
    ELSE 'Deep sync started: ' || (total - stored) || ' matches enqueued' END AS message
FROM ({counted('SELECT * FROM rec420 WHERE place < 100')})""", IDS)
sql("sync_status", f"""
, n AS (SELECT *, puuid * 7 % {NOW_S} AS started, {NOW_S} - puuid * 7 % {NOW_S} < 1800 AS alive FROM ({counted('SELECT * FROM rec420 WHERE place < 100')}))
SELECT puuid, CASE WHEN NOT alive THEN 'IDLE' WHEN stored >= total THEN 'DONE' ELSE 'SYNCING' END AS status, CASE WHEN alive THEN stored ELSE 0 END AS "matchesProcessed",
  CASE WHEN alive THEN total ELSE 0 END AS "matchesTotal", CASE WHEN alive THEN started END AS "startedAt",
  CASE WHEN NOT alive THEN 'Nenhum sync em andamento' WHEN stored >= total THEN 'Sync concluído: ' || stored || '/' || total || ' partidas processadas'
    ELSE 'Sync em andamento: ' || stored || '/' || total || ' partidas processadas' END AS message FROM n""", IDS)
sql("update_status", f"""
SELECT puuid, CASE WHEN stored = total THEN 'IDLE' ELSE 'UPDATING' END AS status, stored AS "matchesProcessed", total AS "matchesTotal",
  CASE WHEN stored = total THEN 'All matches processed' ELSE 'Processing matches: ' || stored || '/' || total END AS message
FROM ({counted('SELECT * FROM rec WHERE place < 20')})""", IDS)
sql("request_window", f"""
SELECT substring(sha256(event_type), 1, 16) AS "keyId", ms AS ts_ms, n AS "requestsInWindow", {AUDIT_LIMIT} AS "maxRequests", n < {AUDIT_LIMIT} AS "canProceed" FROM (
  SELECT event_type, ms, count(*) OVER (PARTITION BY event_type ORDER BY ms RANGE BETWEEN {AUDIT_SECONDS * 1000 - 1} PRECEDING AND CURRENT ROW) AS n
  FROM (SELECT DISTINCT event_type, epoch_us(ts) // 1000 AS ms FROM events))""")

_TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def statements() -> dict[str, str]:
    """Name to statement, every column cast to its declared type."""
    out = {}
    for name, (ctes, body) in BODIES.items():
        body = body.strip()
        more = "".join(", " + c.strip() for c in ctes)
        if body.startswith(","):
            # The body opens with common table expressions of its own; its final SELECT starts a line.
            head, tail = body.rsplit("\nSELECT", 1) if "\nSELECT" in body else body.rsplit("\n    SELECT", 1)
            more, body = more + head, "SELECT" + tail
        columns = ", ".join(f'CAST("{c}" AS {_TYPES[t]}) AS "{c}"' for c, t in registry.COLUMNS[name])
        out[name] = f"WITH {BASE.strip()}{more}\nSELECT {columns} FROM (\n{body}\n) AS result"
    return out
