"""Move trees: a user's day is a game, its events the moves; a game's value counts all of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.registry import query
from catalog.summary_queries import rounded
from wardline.operators import matching, tree
from wardline.plans import openings
from wardline.scale import null_safe_join

DEPTH = 10  # deepest node of a tree
LATE = 24  # longest prefix that any operator looks at


def sequences(t):
    """Moves of each game as far as the operators look, and its total over all moves; the rank limit acts before the exchange."""
    game = [F.col("user_id"), F.col("ts").cast("date").alias("day")]
    events = t.events.select(*game, "ts", "event_id", "event_type", "value")
    ranked = events.withColumn("ply", F.row_number().over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id"))).filter(F.col("ply") <= LATE)
    games = ranked.groupBy("user_id", "day").agg(F.sort_array(F.collect_list(F.struct("ply", "event_type"))).alias("_m"))
    totals = events.groupBy("user_id", "day").agg(F.sum("value").alias("total"))
    plays = games.select("user_id", "day", F.transform("_m", lambda s: s["event_type"]).alias("play"))
    return null_safe_join(plays, totals, ["user_id", "day"])


SEQ_SQL = f"""seqs AS (SELECT user_id, CAST(ts AS DATE) AS day, list(event_type ORDER BY ts, event_id) AS play, sum(value) AS total FROM events GROUP BY 1, 2),
nodes AS (SELECT play[1:d] AS play, d AS depth, count(*) AS games, avg(total) AS v FROM (SELECT play, total, unnest(range(1, least(len(play), {DEPTH}) + 1)) AS d FROM seqs) GROUP BY 1, 2)"""


def text_sql(play: str) -> str:
    return f"""array_to_string(list_transform({play}, lambda m, i: CASE WHEN i % 2 = 1 THEN CAST((i + 1) // 2 AS VARCHAR) || '. ' || m ELSE m END), ' ')"""


def nodes(t):
    return openings.node_table(sequences(t), "play", "total", DEPTH)


@query("sequence_nodes", f"""WITH {SEQ_SQL} SELECT array_to_string(play, ',') AS play, CAST(depth AS INTEGER) AS depth, games, round(v, 6) AS value, play[-1] AS move,
CASE WHEN depth % 2 = 1 THEN 'w' ELSE 'b' END AS made_move, {text_sql('play')} AS pgn, {text_sql('play[1:depth - 1]')} AS parent_pgn FROM nodes""")
def sequence_nodes(t):
    return rounded(nodes(t), "value").withColumn("play", F.array_join("play", ","))


@query("sequence_depth", f"WITH {SEQ_SQL} SELECT array_to_string(play, ',') AS play, CAST(depth AS INTEGER) AS depth, depth % 2 = 1 AS made_move FROM nodes")
def sequence_depth(t):
    halves = nodes(t).select("play", (F.col("depth") / 2).alias("depth"), "made_move")
    return tree.sequence_depth(halves).withColumn("play", F.array_join("play", ","))


@query("link_parents", f"""WITH {SEQ_SQL} SELECT {text_sql('n.play')} AS pgn, {text_sql('p.play')} AS parent_id FROM nodes n LEFT JOIN nodes p ON p.play = n.play[1:n.depth - 1] AND n.depth > 1""")
def link_parents(t):
    return tree.link_parents(nodes(t).select("play", "pgn"), "play", "pgn").select("pgn", "parent_id")


# a book of named openings: well-trodden nodes of one, two, three and five plies
BOOK_SQL = "book AS (SELECT play, array_to_string(play, '-') AS name FROM nodes WHERE (depth <= 3 OR depth = 5) AND games >= 12)"


def book(t):
    well = nodes(t).filter("(depth <= 3 OR depth = 5) AND games >= 12")
    return well.select(F.col("play").alias("line"), F.array_join("play", "-").alias("name"))


LABEL_SQL = f"""{SEQ_SQL}, {BOOK_SQL}, hits AS (SELECT s.user_id, s.day, b.name, len(b.play) AS n FROM (SELECT user_id, day, play, unnest(range(1, len(play) + 1)) AS d FROM seqs) s
JOIN book b ON b.play = s.play[1:d]), labels_ AS (SELECT s.user_id, s.day, s.total, e.early_label, l.late_label FROM seqs s
LEFT JOIN (SELECT user_id, day, arg_max(name, n) AS early_label FROM hits WHERE n <= 4 GROUP BY 1, 2) e ON s.user_id = e.user_id AND s.day = e.day
LEFT JOIN (SELECT user_id, day, arg_max(name, n) AS late_label FROM hits WHERE n > 4 AND n <= {LATE} GROUP BY 1, 2) l ON s.user_id = l.user_id AND s.day = l.day)"""


def labelled(t):
    return tree.label_by_prefix(sequences(t), "play", ["user_id", "day"], book(t), "line", "name", late=LATE)


@query("label_by_prefix", f"WITH {LABEL_SQL} SELECT user_id, day, early_label, late_label FROM labels_")
def label_by_prefix(t):
    return labelled(t).select("user_id", "day", "early_label", "late_label")


@query("explode_labels", f"WITH {LABEL_SQL}, x AS (SELECT user_id, day, unnest(CASE WHEN early_label IS NULL AND late_label IS NULL THEN [NULL] "
       "ELSE list_filter([early_label, late_label], lambda v: v IS NOT NULL) END) AS label FROM labels_) SELECT * FROM x")
def explode_labels(t):
    both = labelled(t).select("user_id", "day", F.array_compact(F.array("early_label", "late_label")).alias("labels"))
    return tree.explode_labels(both, "labels", "label")


@query("carry_forward", f"""WITH {SEQ_SQL}, l AS (SELECT play, depth, CASE WHEN games >= 40 THEN array_to_string(play, '-') END AS label FROM nodes)
SELECT array_to_string(n.play, ',') AS play, n.label, coalesce(n.label, (SELECT arg_max(a.label, a.depth) FROM l a WHERE a.label IS NOT NULL AND a.play = n.play[1:a.depth])) AS carried FROM l n""")
def carry_forward(t):
    named = nodes(t).select("play", F.when(F.col("games") >= 40, F.array_join("play", "-")).alias("label"))
    return tree.carry_forward_label(named, "play", "label").withColumn("play", F.array_join("play", ","))


def _rollup_sql() -> str:
    parts = [f"lvl{DEPTH} AS (SELECT play, v AS mx, v AS mn, v AS av, 0.0 AS sd FROM nodes WHERE depth = {DEPTH})"]
    for d in range(DEPTH - 1, 0, -1):
        parts.append(f"""lvl{d} AS (SELECT n.play, coalesce(u.mx, n.v) AS mx, coalesce(u.mn, n.v) AS mn, coalesce(u.av, n.v) AS av, coalesce(u.sd, 0.0) AS sd FROM nodes n
LEFT JOIN (SELECT play[1:{d}] AS play, max(mx) AS mx, min(mn) AS mn, avg(av) AS av, stddev_pop(av) AS sd FROM lvl{d + 1} GROUP BY 1) u ON n.play = u.play WHERE n.depth = {d})""")
    every = " UNION ALL ".join(f"SELECT * FROM lvl{d}" for d in range(1, DEPTH + 1))
    return f"{SEQ_SQL}, {', '.join(parts)}, rolled AS ({every})"


ROLL_SQL = _rollup_sql()


def scored(t):
    return openings.scored_tree(nodes(t), DEPTH)


@query("rollup_tree", f"WITH {ROLL_SQL} SELECT array_to_string(play, ',') AS play, round(mx, 6) AS max_value, round(mn, 6) AS min_value, round(av, 6) AS avg_value, round(sd, 6) AS sd_value FROM rolled")
def rollup_tree(t):
    out = scored(t).select(F.array_join("play", ",").alias("play"), "max_value", "min_value", "avg_value", "sd_value")
    return rounded(out, "max_value", "min_value", "avg_value", "sd_value")


@query("risk_score", f"WITH {ROLL_SQL} SELECT array_to_string(r.play, ',') AS play, games, round(av - sd, 6) AS score FROM rolled r JOIN nodes n ON n.play = r.play")
def risk_score(t):
    scores = rounded(scored(t).select("play", "score"), "score")
    joined = matching.merge_on_text_key(scores, nodes(t).select("play", "games"), "play")
    return joined.withColumn("play", F.array_join("play", ","))


@query("best_moves", f"""WITH {ROLL_SQL}, c AS (SELECT array_to_string(play[1:len(play) - 1], ',') AS parent, play[-1] AS move, av - sd AS score FROM rolled)
SELECT parent, move, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY round(score, 6) DESC, move) AS rn FROM c) WHERE rn = 1""")
def best_moves(t):
    return openings.best_moves(rounded(scored(t), "score"))


@query("weighted_choice", f"""WITH {SEQ_SQL}, c AS (SELECT array_to_string(play[1:depth - 1], ',') AS parent, play[-1] AS move, games FROM nodes),
u AS (SELECT parent, move, -ln((CAST('0x' || substr(md5(concat_ws('|', '9', parent, move)), 1, 8) AS BIGINT) + 0.5) / 4294967296.0) / games AS race FROM c)
SELECT parent, move FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY race, move) AS rn FROM u) WHERE rn = 1""")
def weighted_choice(t):
    return openings.drawn_moves(nodes(t), 9)


@query("opening_profile", f"""WITH {LABEL_SQL} SELECT coalesce(early_label, 'No opening identified') AS opening, round(min(total), 6) AS min_value, round(max(total), 6) AS max_value,
round(avg(total), 6) AS mean_value, round(stddev_samp(total), 6) AS sd_value, count(total) AS n FROM labels_ GROUP BY 1""")
def opening_profile(t):
    out = openings.opening_profile(labelled(t), "early_label", "total")
    return rounded(out, "min_value", "max_value", "mean_value", "sd_value")


@query("conversation_roles", """WITH s AS (SELECT conv_id, list(role ORDER BY turn) AS play FROM conversations GROUP BY conv_id)
SELECT array_to_string(play[1:d], ',') AS play, count(*) AS games, CAST(d AS INTEGER) AS depth FROM (SELECT play, unnest(range(1, len(play) + 1)) AS d FROM s) GROUP BY 1, 3""")
def conversation_roles(t):
    top = t.conversations.select("conv_id", "turn", "role").withColumn("ply", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    plays = top.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("ply", "role"))).alias("_m"))
    plays = plays.select(F.transform("_m", lambda s: s["role"]).alias("play"))
    return tree.tree_nodes(plays, "play").withColumn("play", F.array_join("play", ","))
