"""Sequential ratings.

A rating after a match needs every earlier match of both sides, so a league
system is folded in order. The fold streams: rows arrive sorted in Arrow
batches and only the ratings of the current league are held, never its rows.
Leagues, parameter points and seeds run side by side.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kickline.operators.blocks import rows_per_block, same_key
from kickline.operators.joins import sized_broadcast
from kickline.operators.systems import with_system
from kickline.session import scratch_path, stage

# fixed values
ELO_K, ELO_HOME, ELO_START, SEASON_PULL = 20.0, 65.0, 1500.0, 0.25
PI_BASE, PI_DAMP = 10.0, 3.0
PI_LAMBDA_GRID = (0.06, 0.10, 0.15, 0.20, 0.30, 0.45)
PI_GAMMA_GRID = (0.3, 0.5, 0.7, 0.85, 1.0)
PI_LAMBDA, PI_GAMMA = 0.20, 0.70
POISSON_K, POISSON_HOME, POISSON_CAP = 0.02, 0.25, 1.5
POISSON_K_GRID = (0.005, 0.01, 0.02, 0.035, 0.05, 0.08)
POISSON_HOME_GRID = (0.10, 0.18, 0.25, 0.32)

MATCH = ["season", "kick", "fixture_id", "home", "away", "gf", "gc"]


def with_history(window: DataFrame, history: DataFrame, own_division: str) -> DataFrame:
    """The window's matches plus the deep history, without the history's copy of the window."""
    seasons = window.select("season").distinct().withColumn("division", F.lit(own_division))
    older = history.join(sized_broadcast(seasons), ["season", "division"], "left_anti")
    return (window.withColumn("src", F.lit("window"))
            .unionByName(older.withColumn("src", F.lit("history")), allowMissingColumns=True))


class EloState:
    """Elo with home edge, logarithmic margin and a pull towards the mean between seasons."""

    columns = "elo_home double, elo_away double, surprise double, expected_home double"

    def __init__(self, params):
        self.rating: dict[str, float] = {}
        self.season = None
        self.members: dict[str, set[str]] = {}

    def new_season(self) -> None:
        groups = list(self.members.values())
        if not groups:
            targets = [(self.rating.keys(), ELO_START)]
        else:
            targets = []
            for g in groups:
                here = [t for t in sorted(g) if t in self.rating]
                if here:
                    targets.append((here, sum(self.rating[t] for t in here) / len(here)))
        for teams, mean in targets:
            for t in list(teams):
                self.rating[t] += (mean - self.rating[t]) * SEASON_PULL

    def step(self, season, home, away, gf, gc, members=None) -> tuple:
        if season != self.season:
            if members is not None:
                self.members = {str(i): set(m) for i, m in enumerate(members)}
            self.new_season()
            self.season = season
        h, a = self.rating.get(home, ELO_START), self.rating.get(away, ELO_START)
        expected = 1.0 / (1.0 + 10.0 ** ((a - h - ELO_HOME) / 400.0))
        margin = gf - gc
        score = 1.0 if margin > 0 else 0.5 if margin == 0 else 0.0
        move = ELO_K * (1.0 + math.log1p(abs(margin))) * (score - expected)
        self.rating[home], self.rating[away] = h + move, a - move
        return h + move, a - move, abs(score - expected), expected

    def dump(self):
        return [self.rating, self.season, {k: sorted(v) for k, v in self.members.items()}]

    def load(self, saved) -> None:
        self.rating, self.season = saved[0], saved[1]
        self.members = {k: set(v) for k, v in saved[2].items()}


class PiState:
    """Separate home and away ratings with transfer between them; predicts the goal difference."""

    columns = ("home_pi_home double, home_pi_away double, away_pi_home double, away_pi_away double, "
               "gd_expected double, error double")

    def __init__(self, params):
        self.rate, self.transfer = params
        self.at_home: dict[str, float] = {}
        self.on_road: dict[str, float] = {}

    @staticmethod
    def goals(r: float) -> float:
        return math.copysign(10.0 ** (abs(r) / PI_BASE) - 1.0, r)

    def step(self, season, home, away, gf, gc) -> tuple:
        hh, ha = self.at_home.get(home, 0.0), self.on_road.get(home, 0.0)
        ah, aa = self.at_home.get(away, 0.0), self.on_road.get(away, 0.0)
        expected = self.goals(hh) - self.goals(aa)
        gap = float(gf - gc) - expected
        direction = (gap > 0) - (gap < 0)
        move = direction * self.rate * PI_DAMP * math.log10(1.0 + abs(gap))
        hh, ha = hh + move, ha + move * self.transfer
        aa, ah = aa - move, ah - move * self.transfer
        self.at_home[home], self.on_road[home] = hh, ha
        self.at_home[away], self.on_road[away] = ah, aa
        return hh, ha, ah, aa, expected, abs(gap)

    def dump(self):
        return [self.at_home, self.on_road]

    def load(self, saved) -> None:
        self.at_home, self.on_road = saved


class PoissonState:
    """Attack and defence by an online Poisson gradient, clipped, shrunk between seasons."""

    columns = ("home_attack double, home_defence double, away_attack double, away_defence double, "
               "lam_home double, lam_away double")

    def __init__(self, params):
        self.k, self.edge, self.mu = params
        self.attack: dict[str, float] = {}
        self.defence: dict[str, float] = {}
        self.season = None

    def step(self, season, home, away, gf, gc) -> tuple:
        if season != self.season:
            for side in (self.attack, self.defence):
                for t in side:
                    side[t] *= 1.0 - SEASON_PULL
            self.season = season
        ha, hd = self.attack.get(home, 0.0), self.defence.get(home, 0.0)
        aa, ad = self.attack.get(away, 0.0), self.defence.get(away, 0.0)
        lh, la = math.exp(self.mu + ha - ad + self.edge), math.exp(self.mu + aa - hd)
        eh, ea = self.k * (gf - lh), self.k * (gc - la)

        def clip(x: float) -> float:
            return max(-POISSON_CAP, min(POISSON_CAP, x))

        ha, ad, aa, hd = clip(ha + eh), clip(ad - eh), clip(aa + ea), clip(hd - ea)
        self.attack[home], self.defence[home] = ha, hd
        self.attack[away], self.defence[away] = aa, ad
        return ha, hd, aa, ad, lh, la

    def dump(self):
        return [self.attack, self.defence, self.season]

    def load(self, saved) -> None:
        self.attack, self.defence, self.season = saved


def chunk_borders(rows: DataFrame, keys: list[str], time: str) -> tuple[DataFrame, int] | None:
    """`keys, _borders` of every key with more rows than one task should walk, and the number of chunks; None without such a key.

    The borders are quantiles of the key's own instants, so chunks hold equal numbers of rows however the
    instants lie. There are at most rows / rowsPerBlock such keys, with as many borders as the largest needs.
    """
    limit = rows_per_block(rows.sparkSession)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    most = sizes.agg(F.max("_n")).first()[0]
    if most is None:
        return None
    chunks = -(-most // limit)
    shares = [i / chunks for i in range(1, chunks)]
    hot = rows.alias("d").join(F.broadcast(sizes.alias("s")), same_key("d", "s", keys), "left_semi")
    cut = F.array_distinct(F.percentile_approx(time, F.lit(shares), 20 * chunks + 10_000))
    return stage(hot.groupBy(*keys).agg(cut.alias("_borders")), "borders"), chunks


def fold(matches: DataFrame, league: list[str], state: Callable, params: list[str] | None = None,
         extra: list[str] | None = None, emit: list[str] | None = None) -> DataFrame:
    """Runs `state` over each league (and parameter point) in match order, one output row per match.

    Matches are hash-partitioned by league and parameter point and sorted inside
    the partition; the function walks the sorted batches and starts afresh when
    the key changes. `emit` names the match columns wanted back. The order of matches is the one thing that cannot be split,
    so a league with more rows than one task should hold is folded in chunks of equal row counts: the input
    is written once, partitioned by chunk; each pass reads its chunk only, is written before the next starts
    from the ratings it left, and a lost executor costs one chunk.
    """
    params, extra, emit = params or [], extra or [], emit or MATCH
    keys = [*league, *params]
    spark, none = matches.sparkSession, F.lit(None).cast("string")
    rows = matches.select(*keys, *MATCH, *extra)
    cut = chunk_borders(rows, keys, "kick")
    if cut is None:
        return _fold_pass(rows.withColumn("saved", none), keys, len(league), state, False, emit)

    borders, chunks = cut
    known = F.broadcast(borders.alias("b"))   # bounded by rows / rowsPerBlock
    chunk = F.coalesce(F.size(F.filter("b._borders", lambda x: x < F.col("d.kick"))), F.lit(0))
    chunk = F.when(F.col("b._borders").isNull(), F.lit(0)).otherwise(chunk)
    staged = stage(rows.alias("d").join(known, same_key("d", "b", keys), "left").select("d.*", chunk.alias("_chunk")), "fold-input", ["_chunk"])
    root, carried, paths = scratch_path(spark, "fold"), None, []
    for i in range(chunks):
        part = staged.filter(F.col("_chunk") == i).drop("_chunk").withColumn("saved", none)
        if carried is not None:
            # integers stay integers in the batches: the carried row sorts first without nulls
            part = part.unionByName(carried.withColumns(
                {"kick": F.lit(-(1 << 62)), "fixture_id": F.lit(-1), "season": F.lit(0), "gf": F.lit(0), "gc": F.lit(0)}),
                allowMissingColumns=True)
        out = _fold_pass(part, keys, len(league), state, True, emit)
        paths.append(f"{root}/{i}")
        out.write.parquet(paths[-1])
        left = spark.read.schema(out.schema).parquet(paths[-1]).filter(F.col("saved").isNotNull()).select(*keys, "saved")
        carried = left.alias("d").join(known, same_key("d", "b", keys), "left_semi")
    return spark.read.schema(out.schema).parquet(*paths).filter(F.col("saved").isNull()).drop("saved")


def _fold_pass(rows: DataFrame, keys: list[str], n_league: int, state: Callable, with_state: bool,
               emit: list[str]) -> DataFrame:
    """One sorted walk. A row with `saved` carries the ratings to start from; with `with_state`
    such a row is also emitted at the end of every key."""
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "kick", "fixture_id")
    keep = [*keys, *emit]
    types = dict(rows.dtypes)
    fields = [f"`{c}` {types[c]}" for c in keep] + [state.columns] + (["saved string"] if with_state else [])
    names = [c.strip().split(" ")[0] for c in state.columns.split(",")]
    extra = [c for c in rows.columns if c not in {*keys, *MATCH, "saved"}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, st, closed = None, None, []

        def close() -> None:
            if with_state and current is not None:
                closed.append((current, json.dumps(st.dump())))

        def states(schema: pa.Schema) -> pa.RecordBatch:
            n = len(closed)
            cols = [pa.array([key[i] for key, _ in closed], schema.field(k).type) for i, k in enumerate(keys)]
            cols += [pa.nulls(n, schema.field(c).type) for c in emit] + [pa.nulls(n, pa.float64()) for _ in names]
            cols.append(pa.array([s for _, s in closed], pa.string()))
            closed.clear()
            return pa.RecordBatch.from_arrays(cols, [*keep, *names, "saved"])

        schema = None
        for batch in batches:
            schema = batch.schema
            col = {f.name: batch.column(i) for i, f in enumerate(schema)}
            columns = [col[c].to_pylist() for c in ("season", "home", "away", "gf", "gc", *extra)]
            values, kept = [], []
            # the rows are sorted by key: with equal ends a batch is of one league and needs no look at every row
            ends = [tuple(col[k][i].as_py() for k in keys) for i in (0, -1)] if batch.num_rows else [None, ()]
            whole = ends[0] == ends[1] and col["saved"].null_count == batch.num_rows
            if whole:
                if ends[0] != current:
                    close()
                    current, st = ends[0], state(ends[0][n_league:])
                step = st.step
                values, kept = [step(*match) for match in zip(*columns)], range(batch.num_rows)
            for i, (key, saved, *match) in enumerate(() if whole else zip(
                    zip(*[col[k].to_pylist() for k in keys]), col["saved"].to_pylist(), *columns)):
                if key != current:
                    close()
                    current, st = key, state(key[n_league:])
                if saved is not None:
                    st.load(json.loads(saved))
                    continue
                kept.append(i)
                values.append(st.step(*match))
            cols = [col[c] for c in keep]
            if len(kept) < batch.num_rows:
                cols = [c.take(pa.array(kept, pa.int64())) for c in cols]
            cols += [pa.array(v, pa.float64()) for v in (zip(*values) if values else [[]] * len(names))]
            if with_state:
                cols.append(pa.nulls(len(kept), pa.string()))
            yield pa.RecordBatch.from_arrays(cols, [*keep, *names, *(["saved"] if with_state else [])])
            if closed:
                yield states(schema)
        close()
        if closed:
            yield states(schema)

    return ordered.mapInArrow(run, ", ".join(fields))


def as_matches(df: DataFrame, gf: str = "home_goals", gc: str = "away_goals") -> DataFrame:
    return df.withColumns({"gf": F.col(gf).cast("long"), "gc": F.col(gc).cast("long")})


def elo(matches: DataFrame, league: list[str]) -> DataFrame:
    return fold(matches, league, EloState)


def elo_seeded(matches: DataFrame, division: str = "division") -> DataFrame:
    """Elo over deep history, one walk per rating system (`system`): between seasons ratings are pulled to the mean of the division's
    teams of the new season. The line-up of every division rides on the season's first match."""
    matches, league = with_system(matches), ["system"]
    sides = matches.select(*league, "season", division, F.explode(F.array("home", "away")).alias("_t")).distinct()
    groups = (sides.groupBy(*league, "season", division).agg(F.sort_array(F.collect_set("_t")).alias("_m"))   # teams of a division
              .groupBy(*league, "season").agg(F.sort_array(F.collect_list("_m")).alias("members")))
    first = (matches.groupBy(*league, "season").agg(F.min(F.struct("kick", "fixture_id")).alias("_f"))
             .join(groups, [*league, "season"])
             .select(*league, "season", F.col("_f.kick").alias("kick"), F.col("_f.fixture_id").alias("fixture_id"), "members"))
    tagged = matches.join(sized_broadcast(first), [*league, "season", "kick", "fixture_id"], "left")
    return fold(tagged, league, EloState, extra=["members"])


def pi_ratings(matches: DataFrame, league: list[str], rate: float = PI_LAMBDA, transfer: float = PI_GAMMA) -> DataFrame:
    return fold(matches.withColumns({"rate": F.lit(rate), "transfer": F.lit(transfer)}), league, PiState, ["rate", "transfer"])


def mean_log_goals(matches: DataFrame, league: list[str], train: list[int] | None = None) -> DataFrame:
    """log of the mean goals per team and match, over the training seasons when given."""
    rows = matches.filter(F.col("season").isin(train)) if train else matches
    return rows.groupBy(*league).agg(F.log(F.greatest((F.avg("gf") + F.avg("gc")) / 2, F.lit(0.1))).alias("mu"))


def attack_defence(matches: DataFrame, league: list[str], train: list[int] | None = None,
                   k: float = POISSON_K, edge: float = POISSON_HOME) -> DataFrame:
    mu = mean_log_goals(matches, league, train)
    tagged = matches.join(mu, league).withColumns({"k": F.lit(k), "edge": F.lit(edge)})
    return fold(tagged, league, PoissonState, ["k", "edge", "mu"])


class PiGrid:
    """Pi ratings of all grid points at once: a rating is an array over the points."""

    def __init__(self, points, mu):
        self.rate, self.transfer = points
        self.at_home: dict[str, np.ndarray] = {}
        self.on_road: dict[str, np.ndarray] = {}
        self.zero = np.zeros(len(self.rate))
        self.loss = np.zeros(len(self.rate))

    @staticmethod
    def goals(r: np.ndarray) -> np.ndarray:
        return np.sign(r) * (10.0 ** (np.abs(r) / PI_BASE) - 1.0)

    def step(self, season, home, away, gf, gc, counted: bool) -> None:
        hh, ha = self.at_home.get(home, self.zero), self.on_road.get(home, self.zero)
        ah, aa = self.at_home.get(away, self.zero), self.on_road.get(away, self.zero)
        gap = (gf - gc) - self.goals(hh) + self.goals(aa)
        off = np.abs(gap)
        move = np.sign(gap) * np.log10(1.0 + off) * (self.rate * PI_DAMP)
        crossed = move * self.transfer
        self.at_home[home], self.on_road[home] = hh + move, ha + crossed
        self.at_home[away], self.on_road[away] = ah - crossed, aa - move
        if counted:
            self.loss += off


class PoissonGrid:
    """Attack and defence of all grid points at once; the loss is the deviance of both sides' goals."""

    def __init__(self, points, mu):
        self.k, self.edge, self.mu = *points, mu
        self.attack: dict[str, np.ndarray] = {}
        self.defence: dict[str, np.ndarray] = {}
        self.season = None
        self.zero = np.zeros(len(self.k))
        self.loss = np.zeros(len(self.k))

    def step(self, season, home, away, gf, gc, counted: bool) -> None:
        if season != self.season:
            for side in (self.attack, self.defence):
                for t in side:
                    side[t] = side[t] * (1.0 - SEASON_PULL)
            self.season = season
        ha, hd = self.attack.get(home, self.zero), self.defence.get(home, self.zero)
        aa, ad = self.attack.get(away, self.zero), self.defence.get(away, self.zero)
        lh, la = np.exp(self.mu + ha - ad + self.edge), np.exp(self.mu + aa - hd)
        eh, ea = self.k * (gf - lh), self.k * (gc - la)
        self.attack[home], self.defence[away] = np.clip(ha + eh, -POISSON_CAP, POISSON_CAP), np.clip(ad - eh, -POISSON_CAP, POISSON_CAP)
        self.attack[away], self.defence[home] = np.clip(aa + ea, -POISSON_CAP, POISSON_CAP), np.clip(hd - ea, -POISSON_CAP, POISSON_CAP)
        if counted:
            for y, lam in ((gf, lh), (gc, la)):
                self.loss += (y * np.log(y / lam) if y > 0 else 0.0) - (y - lam)   # half the deviance of a side


def grid_losses(matches: DataFrame, league: list[str], state: Callable, names: list[str], points: list[tuple], train: list[int]) -> DataFrame:
    """`names, loss, n`: the mean loss of every grid point over the matches of the training seasons.

    Every league is walked once for all points, in batches; only the losses and the number of counted
    matches leave the task. `matches` may carry a column mu, constant within a league.
    """
    extra = ["mu"] if "mu" in matches.columns else []
    rows = matches.select(*league, *MATCH, *extra, F.col("season").isin(train).alias("counted"))
    ordered = rows.repartition(*league).sortWithinPartitions(*league, "kick", "fixture_id")
    grid = [np.array(x, float) for x in zip(*points, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, st, n, done = None, None, 0, []
        for batch in batches:
            col = {f: batch.column(f).to_pylist() for f in (*league, "season", "home", "away", "gf", "gc", "counted", *extra)}
            mus = col["mu"] if extra else [None] * batch.num_rows
            for key, mu, *match in zip(zip(*[col[k] for k in league], strict=True), mus, *[col[c] for c in ("season", "home", "away", "gf", "gc", "counted")], strict=True):
                if key != current:
                    if st is not None:
                        done.append((st.loss, n))
                    current, st, n = key, state(grid, mu), 0
                st.step(*match)
                n += match[-1]
        if st is not None:
            done.append((st.loss, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x.tolist() for x, _ in done], pa.list_(pa.float64())), pa.array([x for _, x in done], pa.int64())], names=["losses", "n"])

    walked = ordered.mapInArrow(run, "losses array<double>, n long")
    named = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(names, p, strict=True)]) for p in points])
    each = walked.select("n", F.explode(F.arrays_zip(named.alias("point"), F.col("losses").alias("sum"))).alias("x"))
    return each.groupBy(*[F.col(f"x.point.{k}").alias(k) for k in names]).agg((F.sum("x.sum") / F.sum("n")).alias("loss"), F.sum("n").alias("n"))


def pi_grid(matches: DataFrame, league: list[str], train: list[int], rates: tuple = PI_LAMBDA_GRID, transfers: tuple = PI_GAMMA_GRID) -> DataFrame:
    """Mean absolute goal error per grid point over the training seasons."""
    return grid_losses(matches, league, PiGrid, ["rate", "transfer"], [(x, y) for x in rates for y in transfers], train)


def attack_defence_grid(matches: DataFrame, league: list[str], train: list[int], ks: tuple = POISSON_K_GRID, edges: tuple = POISSON_HOME_GRID) -> DataFrame:
    """Poisson deviance per grid point over the training seasons, the mean of both sides."""
    tagged = matches.join(mean_log_goals(matches, league, train), league)
    return grid_losses(tagged, league, PoissonGrid, ["k", "edge"], [(x, y) for x in ks for y in edges], train)


def per_team(folded: DataFrame, league: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Two rows per match from a folded table. `pairs`: output -> (home column, away column)."""
    from kickline.operators.reshape import two_sides
    return two_sides(folded, [*league, "season", "fixture_id", "kick"], {"team": ("home", "away"), **pairs})
