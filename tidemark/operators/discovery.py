"""Rules of one and two conditions over 26 features of a bar, mined and tested fold by fold, and their nulls under permuted labels.

Records are the bars from the 60th on whose outcome is known, by (series_id, horizon). Numbers become q1, q2, q3 by the
quartiles of the calibration records of a fold; ten features are categories. A condition has a code, so that all conditions
and pairs of a fold are cells of one square table; a table counts, for the real labels and for every permutation at once,
how often a pair of conditions meets a label. A task makes the table of a chunk of records by matrix products; tables of
chunks are added up in a tree. So features are read once however many permutations there are, and what is added does not
grow with the records.

A permutation is a bijection of 0..n-1 computed from a place and a seed (Feistel rounds with cycle walking). Each record sends
its label where the bijection says: three bytes a permutation, packed by chunk, and no row is exploded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import shared
from tidemark.functions.columns import EPS, case, over, ratio, series

c = F.col
HORIZONS, FOLDS, FIRST = (4, 8, 16), 4, 60
CHUNK, FAN_IN = 16_384, 16
LABELS = ("BUY", "SELL", "NEUTRAL")
#: Names, categories and bounds of the features (fixed values).
NUMBERS = (
    "return_5", "return_10", "return_20", "return_30", "return_60", "bullish_ratio", "bearish_ratio", "directional_imbalance", "volatility", "volatility_ratio",
    "location_in_range", "normalized_slope", "momentum_acceleration", "recent_body_ratio", "recent_upper_wick", "recent_lower_wick",
)
CATEGORIES = {
    "latest_candle": ("doji", "strong_bullish", "strong_bearish", "bullish_close_strong", "bearish_close_strong", "hammer_like", "shooting_star_like", "normal"),
    "directional_regime": ("bullish", "bearish", "neutral"),
    "volatility_regime": ("expanding", "contracting", "stable"),
    "location_state": ("upper_range", "lower_range", "middle_range"),
    "trend_consistency": ("strong", "moderate", "weak"),
    "pressure": ("bullish", "bearish", "neutral"),
    "range_event": ("near_high", "near_low", "inside_range"),
    "swing_high_state": ("higher_high", "lower_high", "equal_high", "unknown"),
    "swing_low_state": ("lower_low", "higher_low", "equal_low", "unknown"),
    "structure_regime": ("up_structure", "down_structure", "mixed_structure"),
}
FEATURES = (*NUMBERS, *CATEGORIES)
VALUES = {**{n: ("q1", "q2", "q3") for n in NUMBERS}, **CATEGORIES}
CONDITIONS = [f"{f}={v}" for f in FEATURES for v in VALUES[f]]
OFFSETS = dict(zip(FEATURES, np.cumsum([0, *(len(VALUES[f]) for f in FEATURES)]).tolist(), strict=False))
KEYS = ["series_id", "horizon"]


def features(bars: DataFrame) -> DataFrame:
    """The 26 features of each bar, from the last 60 bars at most."""
    was = lambda n: F.lag("close", n).over(series())
    back = lambda n: F.when(c("idx") >= n, ratio(c("close") - was(n), was(n))).otherwise(0.0)
    span, last20, before20 = F.greatest(c("high") - c("low"), F.lit(EPS)), over(-19), over(-20, -1)
    f = bars.withColumns({
        **{f"return_{n}": back(n) for n in (5, 10, 20, 30, 60)},
        "move": F.when((c("idx") >= 1) & (F.abs(was(1)) >= EPS), (c("close") - was(1)) / was(1)),
        "ups": F.sum((c("close") > c("open")).cast("double")).over(last20), "downs": F.sum((c("close") < c("open")).cast("double")).over(last20),
        "high20": F.max("high").over(last20), "low20": F.min("low").over(last20), "prior_high": F.max("high").over(before20), "prior_low": F.min("low").over(before20),
        "recent_body_ratio": F.abs(c("close") - c("open")) / span, "recent_upper_wick": (c("high") - F.greatest("open", "close")) / span, "recent_lower_wick": (F.least("open", "close") - c("low")) / span,
        "from_low": (c("close") - c("low")) / span, "from_high": (c("high") - c("close")) / span,
    })
    f = f.withColumn("volatility", F.when(F.count("move").over(last20) >= 2, F.stddev_pop("move").over(last20)).otherwise(0.0))
    f = f.withColumns({
        "bullish_ratio": ratio(c("ups"), c("ups") + c("downs")), "bearish_ratio": ratio(c("downs"), c("ups") + c("downs")),
        "volatility_ratio": ratio("volatility", F.when(c("idx") >= 11, F.lag("volatility", 10).over(series())).otherwise(c("volatility"))),
        "location_in_range": ratio(c("close") - c("low20"), c("high20") - c("low20")), "normalized_slope": c("return_60"), "momentum_acceleration": c("return_10") - c("return_20"),
    })
    f = f.withColumn("directional_imbalance", c("bullish_ratio") - c("bearish_ratio"))
    body, up, down, slope, place = c("recent_body_ratio"), c("close") > c("open"), c("close") < c("open"), c("normalized_slope"), c("location_in_range")
    f = f.withColumns({
        "latest_candle": case((body <= 0.10, "doji"), (up & (body >= 0.65) & (c("from_low") >= 0.75), "strong_bullish"), (down & (body >= 0.65) & (c("from_high") >= 0.75), "strong_bearish"), (up & (body >= 0.50), "bullish_close_strong"),
                              (down & (body >= 0.50), "bearish_close_strong"), ((c("recent_lower_wick") >= 0.55) & (body <= 0.35), "hammer_like"), ((c("recent_upper_wick") >= 0.55) & (body <= 0.35), "shooting_star_like"), otherwise="normal"),
        "directional_regime": case((slope > 0.002, "bullish"), (slope < -0.002, "bearish"), otherwise="neutral"),
        "volatility_regime": case((c("volatility_ratio") > 1.15, "expanding"), (c("volatility_ratio") < 0.85, "contracting"), otherwise="stable"),
        "location_state": case((place >= 0.75, "upper_range"), (place <= 0.25, "lower_range"), otherwise="middle_range"),
        "trend_consistency": case((F.abs(slope) >= 0.003, "strong"), (F.abs(slope) >= 0.001, "moderate"), otherwise="weak"),
        "pressure": case((c("directional_imbalance") > 0.15, "bullish"), (c("directional_imbalance") < -0.15, "bearish"), otherwise="neutral"),
        "range_event": case((place >= 0.90, "near_high"), (place <= 0.10, "near_low"), otherwise="inside_range"),
        "swing_high_state": case((c("idx") < 20, "unknown"), (c("high") > c("prior_high"), "higher_high"), (c("high") < c("prior_high"), "lower_high"), otherwise="equal_high"),
        "swing_low_state": case((c("idx") < 20, "unknown"), (c("low") < c("prior_low"), "lower_low"), (c("low") > c("prior_low"), "higher_low"), otherwise="equal_low"),
    })
    regime = case(((c("directional_regime") == "bullish") & (c("swing_high_state") == "higher_high"), "up_structure"), ((c("directional_regime") == "bearish") & (c("swing_low_state") == "lower_low"), "down_structure"), otherwise="mixed_structure")
    return f.withColumn("structure_regime", regime).select("series_id", "idx", "close", *FEATURES)


def records(bars: DataFrame, horizons: tuple[int, ...] = HORIZONS, threshold: float = 0.0005) -> DataFrame:
    """Features with the outcome (BUY or SELL beyond ``threshold``, else NEUTRAL), the record's place and the number n of records."""
    rows = features(bars).withColumn("ahead", F.array(*(F.struct(F.lit(h).alias("horizon"), F.lead("close", h).over(series()).alias("future")) for h in horizons)))
    rows = rows.filter((c("idx") >= FIRST) & (c("close") > 0)).withColumn("a", F.explode("ahead")).filter("a.future is not null")
    change = (c("a.future") - c("close")) / c("close")
    rows = rows.select("series_id", "idx", *FEATURES, "a.horizon", case((change > threshold, "BUY"), (change < -threshold, "SELL"), otherwise="NEUTRAL").alias("outcome"))
    group = Window.partitionBy(*KEYS)
    return rows.withColumns({"place": F.row_number().over(group.orderBy("idx")) - 1, "n": F.count("*").over(group)})


def folded(rows: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Each record once for every fold that it calibrates or that tests it: of n records in folds + 1 parts, fold k has k parts before its test part."""
    part = F.floor(c("n") / (folds + 1))
    fold = F.explode(F.sequence(F.lit(1), F.lit(folds)))
    rows = rows.withColumn("fold", fold).withColumn("calibrates", c("place") < c("fold") * part)
    return rows.filter((part > 0) & (c("place") < (c("fold") + 1) * part)).withColumn("n_calibration", c("fold") * part)


def coded(rows: DataFrame) -> DataFrame:
    """``codes``: a byte for each feature, the number of the condition that the record meets; numbers are cut at their fold's calibration quartiles."""
    by = [*KEYS, "fold"]
    quartile = lambda n: F.percentile(F.when(c("calibrates"), c(n)), F.array(F.lit(0.25), F.lit(0.75)))
    cuts = rows.groupBy(*by).agg(*(quartile(n).alias(f"q_{n}") for n in NUMBERS))
    cut = lambda n: case((c(n) <= c(f"q_{n}")[0], F.lit(0)), (c(n) >= c(f"q_{n}")[1], F.lit(2)), otherwise=F.lit(1))
    kind = lambda n: F.array_position(F.array(*map(F.lit, CATEGORIES[n])), c(n)).cast("int") - 1
    codes = [(cut(n) if n in NUMBERS else kind(n)) + OFFSETS[n] for n in FEATURES]
    label = F.array_position(F.array(*map(F.lit, LABELS)), c("outcome")).cast("int") - 1
    return rows.join(cuts, by).select(*by, "idx", "place", "n", "n_calibration", "calibrates", label.alias("label"), F.unhex(F.concat(*(F.lpad(F.hex(x), 2, "0") for x in codes))).alias("codes"))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(place: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A bijection of 0..n-1, drawn by ``seed``: Feistel rounds on the least even number of bits, repeated while the result is n or more."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    x = place.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> half, x[todo] & mask
        for k in range(6):
            left, right = right, left ^ (mix(right + np.uint64(((seed * 6 + k + 1) * 0x9E3779B97F4A7C15) % (1 << 64))) & mask)
        x[todo] = (left << half) | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def _with_draws(rows: DataFrame, by: list[str], domain: str, draws: int, seed: int) -> DataFrame:
    """Adds ``labels``: the record's own label, then the ones that ``draws`` permutations of the first ``domain`` records bring it, a byte each.

    Records at or beyond ``domain`` keep their own label in every draw.
    """
    here = rows.withColumn("chunk", F.floor(c("place") / CHUNK))
    if not draws:
        return here.withColumn("labels", F.unhex(F.lpad(F.hex("label"), 2, "0")))
    names = dict(rows.dtypes)
    keys = ", ".join(f"{k} {names[k]}" for k in by)

    def send(batches):
        for batch in batches:
            frame = batch.to_pandas()
            for key, part in frame.groupby(by, sort=False):
                n = int(part[domain].iloc[0])
                part = part[part["place"] < n]
                if not len(part):
                    continue
                place, label = part["place"].to_numpy(), part["label"].to_numpy().astype(np.uint8)
                to = np.concatenate([permuted(place, n, seed + k) for k in range(draws)])
                sent = np.zeros(len(to), np.dtype([("place", "<u2"), ("draw", "<u2"), ("label", "u1")]))
                sent["place"], sent["draw"], sent["label"] = to % CHUNK, np.repeat(np.arange(draws), len(place)), np.tile(label, draws)
                chunk = to // CHUNK
                order = np.argsort(chunk, kind="stable")
                at, first = np.unique(chunk[order], return_index=True)
                parts = [p.tobytes() for p in np.split(sent[order], first[1:])]
                yield pa.RecordBatch.from_pydict({**{k: [v] * len(parts) for k, v in zip(by, key, strict=True)}, "chunk": at.astype(np.int64), "sent": pa.array(parts, pa.binary())})

    kinds = np.dtype([("place", "<u2"), ("draw", "<u2"), ("label", "u1")])
    blobs = rows.select(*by, "place", "label", domain).mapInArrow(send, f"{keys}, chunk long, sent binary")

    def meet(own: pa.Table, sent: pa.Table) -> pa.Table:
        labels = np.repeat(own["label"].to_numpy().astype(np.uint8)[:, None], draws + 1, axis=1)
        row_of = np.full(CHUNK, -1)
        row_of[own["place"].to_numpy() % CHUNK] = np.arange(len(labels))
        for blob in sent["sent"].to_pylist():
            got = np.frombuffer(blob, kinds)
            labels[row_of[got["place"]], got["draw"] + 1] = got["label"]
        return own.append_column("labels", pa.array([r.tobytes() for r in labels], pa.binary()))

    schema = ", ".join(f"{n} {k}" for n, k in here.dtypes) + ", labels binary"
    grouped = [*by, "chunk"]
    return here.groupBy(*grouped).cogroup(blobs.groupBy(*grouped)).applyInArrow(meet, schema)


SIZE = len(CONDITIONS)


def _one_hot(codes: np.ndarray) -> np.ndarray:
    hot = np.zeros((len(codes), SIZE), np.float32)
    hot[np.arange(len(codes))[:, None], codes] = 1
    return hot


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    n = table.num_rows
    codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint8).reshape(n, -1).astype(np.int64)
    return codes, np.frombuffer(b"".join(table["labels"].to_pylist()), np.uint8).reshape(n, -1)


def table_of(codes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """(draw, label, condition, condition): how many records meet both conditions (one, on the diagonal) and have the label in the draw."""
    hot = _one_hot(codes)
    out = np.zeros((labels.shape[1], len(LABELS), SIZE, SIZE), np.int32)
    for draw in range(labels.shape[1]):
        for label in range(len(LABELS)):
            own = hot[labels[:, draw] == label]
            out[draw, label] = own.T @ own
    return out


def _upper(tables: np.ndarray) -> np.ndarray:
    return tables[..., np.triu_indices(SIZE)[0], np.triu_indices(SIZE)[1]]


def _tables(rows: DataFrame, by: list[str]) -> DataFrame:
    """One table for each group: (*by, counts), from chunks of records, added up FAN_IN at a time."""
    names = dict(rows.dtypes)
    schema = ", ".join(f"{k} {names[k]}" for k in by) + ", chunk long, counts binary"

    def made(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1)
        counts = _upper(table_of(*_matrix(table))).tobytes()
        return first.select([*by, "chunk"]).append_column("counts", pa.array([counts], pa.binary()))

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in table["counts"].to_pylist()).astype(np.int32)
        return table.slice(0, 1).select([*by, "chunk"]).append_column("counts", pa.array([total.tobytes()], pa.binary()))

    out = rows.groupBy(*by, "chunk").applyInArrow(made, schema)
    most = rows.agg(F.max("n")).head()[0] or 0
    while most > CHUNK:
        most = -(-most // FAN_IN)
        out = out.withColumn("chunk", F.floor(c("chunk") / FAN_IN)).groupBy(*by, "chunk").applyInArrow(added, schema)
    return out.drop("chunk")


_FEATURE_OF = np.repeat(np.arange(len(FEATURES)), [len(VALUES[f]) for f in FEATURES])
_ROWS, _COLUMNS = np.triu_indices(SIZE)
#: Cells of a table that are rules: one condition, or two of different features.
_IS_RULE = (_ROWS == _COLUMNS) | (_FEATURE_OF[_ROWS] != _FEATURE_OF[_COLUMNS])


def rules_of(counts: bytes, least: int, confidence: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each draw and cell: samples, the commonest label (ties: BUY, SELL, NEUTRAL), its share, and whether that is a rule."""
    table = np.frombuffer(counts, np.int32).reshape(-1, len(LABELS), len(_ROWS))
    samples, says = table.sum(1), table.argmax(1)
    share = table.max(1) / np.maximum(samples, 1)
    return samples, says, share, _IS_RULE & (samples >= least) & (share >= confidence)


def ranks_of(samples: np.ndarray, share: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Of each draw: 0 for no rule, else the greater the better: by share, samples, one condition before two, then order of the features."""
    pair = _ROWS != _COLUMNS
    out = np.zeros(samples.shape, np.int32)
    for draw in range(len(samples)):
        cells = np.flatnonzero(good[draw])
        order = np.lexsort((-cells, ~pair[cells], samples[draw, cells], share[draw, cells]))
        out[draw, cells[order]] = np.arange(1, len(cells) + 1)
    return out


def cells_of(codes: np.ndarray) -> np.ndarray:
    """The 351 cells of each record: its conditions and their pairs, as numbers of a table's upper half."""
    a, b = np.triu_indices(codes.shape[1])
    low, high = codes[:, a], codes[:, b]
    return low * SIZE - low * (low - 1) // 2 + high - low


def _prepared(bars: DataFrame, draws: int, scheme: str, seed: int) -> DataFrame:
    """Coded records by fold with their labels. ``scheme``: "all" permutes all records of a series, "calibration" a fold's calibration records."""
    rows = folded(records(bars))
    if scheme == "all":
        base = records(bars).withColumn("label", F.array_position(F.array(*map(F.lit, LABELS)), c("outcome")).cast("int") - 1)
        labels = _with_draws(base.select(*KEYS, "place", "n", "label"), KEYS, "n", draws, seed).select(*KEYS, "place", "labels")
        out = coded(rows).join(labels, [*KEYS, "place"]).withColumn("chunk", F.floor(c("place") / CHUNK))
    else:
        out = _with_draws(coded(rows), [*KEYS, "fold"], "n_calibration", draws, seed)
    return shared.cut(out, "coded")


def _tested(rows: DataFrame, tables: DataFrame, test, schema: str) -> DataFrame:
    """Each chunk of a fold's test records with the fold's table."""
    by = [*KEYS, "fold"]
    chunks = rows.filter(~c("calibrates"))
    to = tables.join(chunks.select(*by, c("chunk").alias("to")).distinct(), by).withColumnRenamed("to", "chunk")
    return chunks.groupBy(*by, "chunk").cogroup(to.groupBy(*by, "chunk")).applyInArrow(test, schema)


TESTED = "series_id string, horizon int, fold int, draw int, n long, predictions long, correct long"


def fold_hits(bars: DataFrame, draws: int, least: int = 20, confidence: float = 0.50, seed: int = 42) -> DataFrame:
    """Of each fold and draw (0: the real labels): test records, those for which a rule speaks, and hits. Rules are mined anew in every draw."""
    rows = _prepared(bars, draws, "all", seed)
    tables = shared.cut(_tables(rows.filter("calibrates"), [*KEYS, "fold"]), "tables")

    def test(part: pa.Table, table: pa.Table) -> pa.Table:
        codes, labels = _matrix(part)
        said, hit = np.zeros(labels.shape[1], np.int64), np.zeros(labels.shape[1], np.int64)
        if table.num_rows:
            samples, says, share, good = rules_of(table["counts"][0].as_py(), least, confidence)
            ranks = ranks_of(samples, share, good)
            for a in range(0, len(codes), 64):
                cells = cells_of(codes[a : a + 64])
                for draw in range(len(ranks)):
                    rank = ranks[draw][cells]
                    best = rank.argmax(1)
                    speaks = rank.max(1) > 0
                    label = says[draw][cells[np.arange(len(cells)), best]]
                    said[draw] += speaks.sum()
                    hit[draw] += (speaks & (label == labels[a : a + 64, draw])).sum()
        n = len(said)
        keys = {k: [part[k][0].as_py()] * n for k in (*KEYS, "fold")}
        return pa.table({**keys, "draw": np.arange(n, dtype=np.int32), "n": np.full(n, len(codes)), "predictions": said, "correct": hit}, schema=_schema(TESTED))

    out = _tested(rows, tables, test, TESTED)
    return out.groupBy(*KEYS, "fold", "draw").agg(*(F.sum(x).alias(x) for x in ("n", "predictions", "correct")))


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])


def walk_forward(bars: DataFrame) -> DataFrame:
    """Each fold's test records, how many a rule decides, and hits."""
    return fold_hits(bars, 0).drop("draw").withColumns({"accuracy": ratio("correct", "predictions"), "coverage": ratio("predictions", "n")})


def label_null(bars: DataFrame, draws: int = 100) -> DataFrame:
    """Hits over all folds against those of rules mined and tested on permuted labels: add-one p of reaching the real accuracy."""
    whole = fold_hits(bars, draws).groupBy(*KEYS, "draw").agg(*(F.sum(x).alias(x) for x in ("n", "predictions", "correct")))
    whole = whole.withColumn("accuracy", ratio("correct", "predictions"))
    real = whole.filter("draw = 0").select(*KEYS, "n", "predictions", "correct", c("accuracy").alias("observed"))
    null = whole.filter("draw > 0").join(real.select(*KEYS, "observed"), KEYS).groupBy(*KEYS)
    null = null.agg(F.avg("accuracy").alias("mean_null"), F.max("accuracy").alias("max_null"), F.count_if(c("accuracy") >= c("observed")).alias("n_reaching"))
    return real.join(null, KEYS).withColumn("p_value", (c("n_reaching") + 1) / (draws + 1.0))


FOUND = "series_id string, horizon int, fold int, draw int, n_rules long, best double, n_above long, baseline double"


def discovery_null(bars: DataFrame, draws: int = 25, least: int = 20, confidence: float = 0.45, matches: int = 5, most: int = 500, seed: int = 341) -> DataFrame:
    """How good the best of a fold's rules looks on its test records when calibration labels are permuted: test labels stay.

    Of each draw (0: the real labels) the rules, in the order of ranks_of, first ``most`` of them, are tested where at least
    ``matches`` test records meet them: their number, the best accuracy, and how many beat the commonest test label's share.
    """
    rows = _prepared(bars, draws, "calibration", seed)
    by = [*KEYS, "fold"]
    tables = _tables(rows.filter("calibrates"), by)
    real = rows.filter(~c("calibrates")).withColumn("labels", F.substring("labels", 1, 1))
    tests = _tables(real, by).withColumnRenamed("counts", "tests")

    def compare(table: pa.Table) -> pa.Table:
        samples, says, share, good = rules_of(table["counts"][0].as_py(), least, confidence)
        ranks = ranks_of(samples, share, good)
        met = np.frombuffer(table["tests"][0].as_py(), np.int32).reshape(len(LABELS), -1)
        total = met.sum(0)
        singles = met[:, (_ROWS == _COLUMNS) & (_FEATURE_OF[_ROWS] == 0)].sum(1)
        baseline = singles.max() / max(singles.sum(), 1)
        out = []
        for draw in range(len(ranks)):
            cells = np.flatnonzero(good[draw])
            cells = cells[np.argsort(-ranks[draw, cells])][:most]
            cells = cells[total[cells] >= matches]
            accuracy = met[says[draw, cells], cells] / total[cells]
            out.append((int(good[draw].sum()), float(accuracy.max(initial=0.0)), int((accuracy > baseline).sum())))
        n = len(out)
        keys = {k: [table[k][0].as_py()] * n for k in by}
        counts, best, above = zip(*out, strict=True)
        return pa.table({**keys, "draw": np.arange(n, dtype=np.int32), "n_rules": counts, "best": best, "n_above": above, "baseline": [baseline] * n}, schema=_schema(FOUND))

    each = tables.join(tests, by).groupBy(*by).applyInArrow(compare, FOUND)
    real = each.filter("draw = 0").select(*by, "baseline", c("n_rules").alias("rules"), c("best").alias("best_accuracy"), c("n_above").alias("above"))
    null = each.filter("draw > 0").groupBy(*by).agg(F.avg("best").alias("mean_best"), F.max("best").alias("max_best"), F.avg("n_rules").alias("mean_rules"), F.avg("n_above").alias("mean_above"))
    return real.join(null, by)


MINED = "series_id string, horizon int, fold int, rule string, n long, says string, confidence double"


def mined_rules(bars: DataFrame, least: int = 20, confidence: float = 0.50) -> DataFrame:
    """The rules of each fold's calibration records, one condition or two of different features."""
    by = [*KEYS, "fold"]
    tables = _tables(_prepared(bars, 0, "calibration", 0).filter("calibrates"), by)

    def name(table: pa.Table) -> pa.Table:
        samples, says, share, good = (x[0] for x in rules_of(table["counts"][0].as_py(), least, confidence))
        cells = np.flatnonzero(good)
        names = [CONDITIONS[a] if a == b else f"{CONDITIONS[a]} & {CONDITIONS[b]}" for a, b in zip(_ROWS[cells], _COLUMNS[cells], strict=True)]
        keys = {k: [table[k][0].as_py()] * len(cells) for k in by}
        return pa.table({**keys, "rule": names, "n": samples[cells], "says": [LABELS[k] for k in says[cells]], "confidence": share[cells]}, schema=_schema(MINED))

    return tables.groupBy(*by).applyInArrow(name, MINED)
