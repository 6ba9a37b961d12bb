"""Queries over tokenizer metrics, runs of the sweep and training histories."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltworks.functions import scaling as sc
from siltworks.functions.text import code_points, utf8_bytes, word_count
from siltworks.operators import fitting, metrics
from siltworks.plans.corpus import DOCS, WORDS, docs
from siltworks.storage import load

VOCAB, BLOCK, BATCH, HIDDEN, PARAMS = 32_000, 1024, 8, 768, 124_000_000
# Name, width and parameters of published models.
MODELS = (("GPT-2-Small", 768, 124_000_000), ("GPT-2-Large", 1280, 774_000_000), ("Llama-3.2-1B", 2048, 1_230_000_000), ("Llama-3.2-3B", 3072, 3_210_000_000), ("Llama-3.1-8B", 4096, 8_030_000_000))
FINAL_BUDGET = 1e17
LR = {"peak": 6e-4, "low": 6e-5, "warmup": 100}


def sweep(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "vocab_sweep").distinct()


def runs(s: SparkSession, d: str) -> DataFrame:
    """Finished runs, each once; rows sent twice are equal."""
    return load(s, d, "isoflop_results").distinct()


def _tokenizers() -> dict[str, Column]:
    """Tokenizers that need no vocabulary; any function of a text column to a count can stand here."""
    t = F.col("text")
    return {"whitespace": word_count(t), "characters": code_points(t), "bytes": utf8_bytes(t)}


def tokenizer_report(s: SparkSession, d: str) -> DataFrame:
    """Fertility (tokens a word) and compression (bytes a token) of each tokenizer and language, and overall."""
    return metrics.report(docs(s, d).where("text <> '' AND lang IS NOT NULL"), _tokenizers())


def knee_vocab(s: SparkSession, d: str) -> DataFrame:
    t = sweep(s, d).where("lang = 'overall'").groupBy("sample_id", "vocab_size").agg(F.max("compression_ratio").alias("compression_ratio"))
    return fitting.elbows(t, ["sample_id"], "vocab_size", "compression_ratio").select("sample_id", F.col("candidates").cast("long").alias("candidates"), "chosen", "knee")


def marginal_gain(s: SparkSession, d: str) -> DataFrame:
    t = sweep(s, d).where("lang = 'overall'").groupBy("sample_id", "vocab_size").agg(F.max("compression_ratio").alias("r"))
    before = F.lag("r").over(Window.partitionBy("sample_id").orderBy("vocab_size"))
    return t.select("sample_id", "vocab_size", F.round(100 * (F.col("r") - before) / before, 6).alias("gain"))


def embedding_share(s: SparkSession, d: str) -> DataFrame:
    t = sweep(s, d).select("vocab_size").distinct()
    return t.select("vocab_size", F.round(F.col("vocab_size") * F.lit(HIDDEN) / F.lit(PARAMS), 9).alias("share"), sc.vocab_label(F.col("vocab_size")).alias("label"))


def model_scale_share(s: SparkSession, d: str) -> DataFrame:
    m = s.createDataFrame(list(MODELS), "model string, hidden int, params long")
    k = sweep(s, d).select("vocab_size").distinct()
    return k.crossJoin(F.broadcast(m)).select("model", "vocab_size", F.round(F.col("vocab_size") * F.col("hidden").cast("long") / F.col("params") * 100, 6).alias("percent"))


def vocab_pivot(s: SparkSession, d: str) -> DataFrame:
    return sweep(s, d).groupBy("sample_id", "vocab_size").pivot("lang", ["es", "hi", "overall", "pt"]).agg(F.max("compression_ratio"))


def vocab_sizes(s: SparkSession, d: str) -> DataFrame:
    return sweep(s, d).groupBy("vocab_size").agg(F.countDistinct("sample_id").alias("samples"), F.count(F.when(F.isnan("fertility"), 1)).alias("unknown_fertility"))


def sweep_report(s: SparkSession, d: str) -> DataFrame:
    """Lines of the report's table, in order of sample, size and language."""
    t = sweep(s, d).where(~F.isnan("fertility") & F.col("fertility").isNotNull())
    # format_number rounds the number itself, format_string its shortest decimal form
    number = lambda c: F.replace(F.format_number(c, 3), F.lit(","), F.lit(""))
    line = F.format_string("| %s | %s | %s | %s |", sc.vocab_label(F.col("vocab_size")), F.col("lang"), number("fertility"), number("compression_ratio"))
    return t.select("sample_id", "vocab_size", "lang", line.alias("line")).orderBy("sample_id", "vocab_size", "lang")


def baseline_ranks(s: SparkSession, d: str) -> DataFrame:
    """Tokenizers of each sample and language by compression, the least first, and how ours compares."""
    t = load(s, d, "baseline_comparison").distinct()
    w = Window.partitionBy("sample_id", "lang")
    ours = F.max(F.when(F.col("repo_id").isNull(), F.col("compression_ratio"))).over(w)
    return t.select("sample_id", "lang", "tokenizer", F.row_number().over(w.orderBy("compression_ratio", "tokenizer")).alias("rank"), F.round(ours / F.col("compression_ratio"), 6).alias("ours_to_this"))


def sample_sizes(s: SparkSession, d: str) -> DataFrame:
    """Measurements of each sample, over all its rows, rows sent twice counting once."""
    t = load(s, d, "sample_stats").distinct()
    return t.groupBy("sample_id").agg(F.count(F.lit(1)).alias("measurements"), F.max("measured_at").cast("date").alias("last_day"), F.sum("heldout_docs").alias("heldout_docs"))


def _shape(width: Column) -> tuple[Column, Column]:
    return sc.layers_for_width(width), sc.heads_for_width(width)


def shape_for_width(s: SparkSession, d: str) -> DataFrame:
    n, h = _shape(F.col("width"))
    return runs(s, d).select("width").distinct().select("width", n.alias("n_layer"), h.alias("n_head"))


def param_counts(s: SparkSession, d: str) -> DataFrame:
    n = sc.layers_for_width(F.col("width"))
    return runs(s, d).select("width").distinct().select("width", sc.num_params(F.col("width"), n, VOCAB, BLOCK).alias("params"), sc.non_embedding_params(F.col("width"), n).alias("non_embedding"))


def grid(s: SparkSession, budgets: DataFrame | None = None) -> DataFrame:
    """Budgets by widths, those whose number of steps lies in the window; the widths are a short fixed list, the budgets another, or given."""
    b = s.createDataFrame([(x,) for x in sc.BUDGETS], "flops_budget double") if budgets is None else budgets.select("flops_budget").distinct()
    w = s.createDataFrame([(x,) for x in sc.WIDTHS], "width int").withColumn("n_params", sc.num_params(F.col("width"), sc.layers_for_width(F.col("width")), VOCAB, BLOCK))
    t = b.crossJoin(F.broadcast(w)).withColumn("max_iters", sc.iters_for_budget(F.col("flops_budget"), F.col("n_params"), BATCH, BLOCK))
    return t.where(F.col("max_iters").between(sc.MIN_ITERS, sc.MAX_ITERS))


def isoflop_grid(s: SparkSession, d: str) -> DataFrame:
    return grid(s)


def isoflop_pending(s: SparkSession, d: str) -> DataFrame:
    """Cells of the grid of the runs' budgets, for the seeds that the budget's runs have, that no run has finished."""
    done = runs(s, d)
    cells = done.select("flops_budget", "seed").distinct().join(grid(s, done).select("flops_budget", "width"), "flops_budget")
    return cells.join(done.select("flops_budget", "width", "seed").distinct(), ["flops_budget", "width", "seed"], "left_anti")


def isoflop_elapsed(s: SparkSession, d: str) -> DataFrame:
    """Time of all runs of each budget whose cells are in the grid of the runs' budgets."""
    t = runs(s, d)
    t = t.join(grid(s, t).select("flops_budget", "width"), ["flops_budget", "width"], "left_semi").groupBy("flops_budget").agg(F.count(F.lit(1)).alias("runs"), F.round(F.sum("elapsed_s"), 3).alias("seconds"))
    return t.select("flops_budget", "runs", "seconds", sc.duration(F.col("seconds")).alias("duration"))


def budget_text(s: SparkSession, d: str) -> DataFrame:
    c = [F.col(x) for x in ("flops_budget", "n_params", "n_layer", "n_head", "n_embd")]
    return runs(s, d).select("run_id", sc.budget_text(*c, BATCH, BLOCK).alias("line"), sc.tokens_for_budget(c[0], c[1]).alias("d"))


def flops_per_second(s: SparkSession, d: str) -> DataFrame:
    t = runs(s, d)
    return t.select("run_id", F.round(F.when(F.col("elapsed_s") > 0, sc.FLOPS_PER_PARAM_TOKEN * F.col("n_params").cast("double") * F.col("tokens") / F.col("elapsed_s")), 0).alias("flops_per_second"))


def nearest_width(s: SparkSession, d: str) -> DataFrame:
    """The multiple of 64 whose model is nearest in size to each run's, the smaller one in a tie."""
    most = runs(s, d).agg(F.max("n_params")).first()[0] or 0
    # a model has more than 12 * width^2 parameters, so that the last width is larger than any run's
    w = s.range(1, max(128, math.isqrt(max(most, 0) // 12) // 64 + 1) + 1).select((F.col("id") * 64).cast("int").alias("w"))
    w = w.select("w", sc.num_params(F.col("w"), sc.layers_for_width(F.col("w")), VOCAB, BLOCK).alias("p")).agg(F.sort_array(F.collect_list(F.struct("p", "w"))).alias("all"))
    t = runs(s, d).select("n_params").distinct().crossJoin(F.broadcast(w))
    best = F.array_min(F.transform("all", lambda x: F.struct(F.abs(x["p"] - F.col("n_params")).alias("d"), x["w"].alias("w"))))
    return t.select("n_params", best["w"].alias("width"))


def cells(s: SparkSession, d: str) -> DataFrame:
    """Means over the seeds of each budget and width; the deviation of a single run is 0, losses that are no number are left out."""
    val, train = F.nanvl("final_val_loss", F.lit(None)), F.nanvl("final_train_loss", F.lit(None))
    t = runs(s, d).select("flops_budget", "width", "seed", "run_id", "n_params", "n_params_non_embedding", val.alias("v"), train.alias("t"))
    return t.groupBy("flops_budget", "width").agg(
        F.count(F.lit(1)).alias("runs"), F.avg("v").alias("val_loss"), F.avg("t").alias("train_loss"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("val_std"),
        F.min_by("n_params", F.struct("seed", "run_id")).alias("n_params"), F.min_by("n_params_non_embedding", F.struct("seed", "run_id")).alias("non_embedding"),
    )


def cell_means(s: SparkSession, d: str) -> DataFrame:
    return cells(s, d).select("flops_budget", "width", "runs", F.round("val_loss", 9).alias("val_loss"), F.round("train_loss", 9).alias("train_loss"), F.round("val_std", 7).alias("val_std"), "n_params")


def cell_ranges(s: SparkSession, d: str) -> DataFrame:
    share = 1 - F.col("non_embedding") / F.col("n_params")
    return cells(s, d).agg(F.round(F.min(share), 9).alias("least_share"), F.round(F.max(share), 9).alias("most_share"), F.round(F.min("val_std"), 7).alias("least_std"), F.round(F.max("val_std"), 7).alias("most_std"))


def _points(s: SparkSession, d: str, least: float = 0.0) -> DataFrame:
    """(loss, flops_budget, x, y): both losses of each cell against the logarithm of its size, budgets from `least`."""
    c = cells(s, d).where(F.col("flops_budget") >= least)
    both = c.select("flops_budget", "n_params", F.expr("stack(2, 'val', val_loss, 'train', train_loss) AS (loss, y)"))
    return both.select("loss", "flops_budget", F.ln("n_params").alias("x"), "y")


def isoflop_parabola(s: SparkSession, d: str) -> DataFrame:
    f = fitting.parabolas(_points(s, d), ["loss", "flops_budget"], "x", "y")
    return f.where("a IS NOT NULL").select("loss", "flops_budget", "n", *[F.round(c, 4).alias(c) for c in ("a", "b", "c")])


def minima(s: SparkSession, d: str, least: float = 0.0) -> DataFrame:
    """(loss, flops_budget, n_opt, d_opt, l_opt) of the budgets whose parabola has a minimum between its points."""
    f = fitting.bracketed_minima(fitting.parabolas(_points(s, d, least), ["loss", "flops_budget"], "x", "y"))
    n = F.exp("x_min")
    return f.select("loss", "flops_budget", n.alias("n_opt"), (F.col("flops_budget") / (sc.FLOPS_PER_PARAM_TOKEN * n)).alias("d_opt"), F.col("y_min").alias("l_opt"))


def budget_minima(s: SparkSession, d: str) -> DataFrame:
    m = minima(s, d, 1e14)
    return m.select("loss", "flops_budget", F.round(F.ln("n_opt"), 5).alias("ln_n_opt"), F.round(F.ln("d_opt"), 5).alias("ln_d_opt"), F.round("l_opt", 5).alias("l_opt"))


def _laws(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = minima(s, d).select("loss", "flops_budget", F.expr("stack(3, 'n', n_opt, 'd', d_opt, 'l', l_opt) AS (what, v)"))
    return fitting.power_laws(m, ["loss", "what"], "flops_budget", "v"), fitting.jackknife(m, ["loss", "what"], "flops_budget", "flops_budget", "v")


def power_law(s: SparkSession, d: str) -> DataFrame:
    p, _ = _laws(s, d)
    return p.select("loss", "what", "points", F.round(F.ln("coefficient"), 5).alias("ln_coefficient"), F.round("exponent", 6).alias("exponent"))


def jackknife_se(s: SparkSession, d: str) -> DataFrame:
    _, j = _laws(s, d)
    return j.select("loss", "what", "points", F.round("se", 6).alias("se"))


def exponent_agreement(s: SparkSession, d: str) -> DataFrame:
    """Whether the exponents of both losses agree within two standard errors."""
    p, j = _laws(s, d)
    t = p.join(j.drop("points"), ["loss", "what"])
    pair = t.groupBy("what").agg(F.abs(F.max(F.when(F.col("loss") == "val", F.col("exponent"))) - F.max(F.when(F.col("loss") == "train", F.col("exponent")))).alias("gap"), F.sqrt(F.sum(F.col("se") ** 2)).alias("se"))
    return fitting.agreement(pair, "gap", "se").select("what", F.round("gap", 5).alias("gap"), F.round(sc.json_number(F.col("se")), 5).alias("se"), "agree")


def recommendation(s: SparkSession, d: str) -> DataFrame:
    """Size, tokens, loss and shape for the final budget, by the laws of the validation loss; as a table and as JSON. The shape is that of the
    multiple of 64 whose model is nearest in size."""
    p, _ = _laws(s, d)
    v = p.where("loss = 'val' AND points >= 2").groupBy().pivot("what", ["n", "d", "l"]).agg(F.max(F.col("coefficient") * F.pow(F.lit(FINAL_BUDGET), F.col("exponent"))))
    r = v.select(F.round(F.ln("n"), 4).alias("ln_n"), F.round(F.ln("d"), 4).alias("ln_d"), F.round(sc.json_number(F.col("l")), 4).alias("l"))
    # a model has more than 12 * width^2 parameters, so that no wider one is nearer
    w = F.explode(F.sequence(F.lit(64), (F.greatest(F.lit(128), F.floor(F.sqrt(F.exp("ln_n") / 12) / 64) * 64 + 64)).cast("int"), F.lit(64)))
    sized = r.select("*", w.alias("n_embd")).withColumn("n_layer", sc.layers_for_width(F.col("n_embd")))
    off = F.abs(sc.num_params(F.col("n_embd"), F.col("n_layer"), VOCAB, BLOCK) - F.exp("ln_n"))
    best = sized.groupBy("ln_n", "ln_d", "l").agg(F.min_by("n_embd", F.struct(off, "n_embd")).alias("n_embd"))
    best = best.withColumn("n_layer", sc.layers_for_width(F.col("n_embd"))).withColumn("n_head", sc.heads_for_width(F.col("n_embd")))
    return best.select("ln_n", "ln_d", "l", "n_layer", "n_head", "n_embd", F.to_json(F.struct("ln_n", "ln_d", "l", "n_layer", "n_head", "n_embd")).alias("json"))


def history(s: SparkSession, d: str) -> DataFrame:
    """One row of each run and step: of rows sent twice, the one that arrived first."""
    t = load(s, d, "train_history").where("run_id IS NOT NULL AND iter IS NOT NULL")
    return t.groupBy("run_id", "iter").agg(F.min(F.struct("arrived_at", "train_loss", "val_loss", "lr", "tokens_seen", "elapsed_s")).alias("r")).select("run_id", "iter", "r.*")


def best_val_so_far(s: SparkSession, d: str) -> DataFrame:
    """The least validation loss up to each evaluation, and its perplexity. A running minimum needs no order across tasks but that
    of steps: minima of blocks of steps are accumulated first, so that a run of any length spreads."""
    t = history(s, d).select("run_id", "iter", F.nanvl("val_loss", F.lit(None)).alias("v")).withColumn("b", F.floor(F.col("iter") / 5000))
    blocks = t.groupBy("run_id", "b").agg(F.min("v").alias("m"))
    before = blocks.select("run_id", "b", F.min("m").over(Window.partitionBy("run_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("m"))
    inside = F.min("v").over(Window.partitionBy("run_id", "b").orderBy("iter").rowsBetween(Window.unboundedPreceding, 0))
    out = t.withColumn("i", inside).join(before, ["run_id", "b"]).where("v IS NOT NULL").withColumn("best", F.least("i", "m"))
    return out.select("run_id", "iter", "best", F.round(F.exp("best"), 6).alias("perplexity"))


def eval_loss_mean(s: SparkSession, d: str) -> DataFrame:
    """Means over the evaluations that have the loss; summed as decimals, so that the order of rows makes no difference."""
    t = history(s, d)
    number = lambda c: F.nanvl(c, F.lit(None)).cast("decimal(18, 6)")
    mean = lambda c: F.round(F.sum(number(c)).cast("double") / F.when(F.count(number(c)) > 0, F.count(number(c))), 6)
    return t.groupBy("run_id").agg(F.count(F.lit(1)).alias("evaluations"), mean("train_loss").alias("train_loss"), mean("val_loss").alias("val_loss"), F.max("tokens_seen").alias("tokens_seen"))


def lr_schedule(s: SparkSession, d: str) -> DataFrame:
    t = history(s, d).select("run_id", "iter")
    most = load(s, d, "isoflop_results").groupBy("run_id").agg(F.max("max_iters").alias("most"))
    return t.join(most, "run_id").select("run_id", "iter", F.round(sc.learning_rate(F.col("iter"), LR["peak"], LR["low"], LR["warmup"], F.col("most")), 12).alias("lr"))


_SWEEP = "v AS (SELECT DISTINCT * FROM vocab_sweep)"
_OVERALL = f"{_SWEEP}, o AS (SELECT sample_id, vocab_size, max(compression_ratio) AS r FROM v WHERE lang = 'overall' GROUP BY ALL)"
_RUNS = "r AS (SELECT DISTINCT * FROM isoflop_results)"
_LAYERS = "greatest(1, round_even(8 * sqrt({w} / 512.0), 0))::BIGINT"
_SHAPES = f"{_RUNS}, w AS (SELECT DISTINCT width, {_LAYERS.format(w='width')} AS n_layer FROM r)"
_PARAMS = f"({VOCAB + BLOCK}::BIGINT * {{w}} + {_LAYERS} * (12::BIGINT * {{w}} * {{w}} + 13 * {{w}}) + 2 * {{w}})"
_GRID = f"""b AS (SELECT unnest([{', '.join(f'{x!r}::DOUBLE' for x in sc.BUDGETS)}]) AS flops_budget), ws AS (SELECT unnest({list(sc.WIDTHS)}) AS width),
  p AS (SELECT width, {_PARAMS.format(w='width')} AS n_params FROM ws),
  g AS (SELECT *, greatest(1, round_even(round_even(flops_budget / (6 * n_params), 0) / {BATCH * BLOCK}, 0))::BIGINT AS max_iters FROM b, p),
  grid AS (SELECT * FROM g WHERE max_iters BETWEEN {sc.MIN_ITERS} AND {sc.MAX_ITERS})"""
_OWN_GRID = "b AS (SELECT DISTINCT flops_budget FROM isoflop_results), " + _GRID.partition(", ws AS")[1][2:] + _GRID.partition(", ws AS")[2]
_CELLS = f"""{_RUNS}, n AS (SELECT *, CASE WHEN isnan(final_val_loss) THEN NULL ELSE final_val_loss END AS v, CASE WHEN isnan(final_train_loss) THEN NULL ELSE final_train_loss END AS t FROM r),
  c AS (SELECT flops_budget, width, count(*) AS runs, avg(v) AS val_loss, avg(t) AS train_loss, coalesce(stddev_samp(v), 0) AS val_std,
    arg_min(n_params, seed::BIGINT * 1000000000 + run_id) AS n_params, arg_min(n_params_non_embedding, seed::BIGINT * 1000000000 + run_id) AS non_embedding FROM n GROUP BY ALL)"""
_FITS = f"""{_CELLS}, pt AS (SELECT 'val' AS loss, flops_budget, ln(n_params) AS x, val_loss AS y FROM c UNION ALL SELECT 'train', flops_budget, ln(n_params), train_loss FROM c),
  u AS (SELECT *, x - avg(x) OVER (PARTITION BY loss, flops_budget) AS u, avg(x) OVER (PARTITION BY loss, flops_budget) AS m FROM pt WHERE y IS NOT NULL),
  q AS (SELECT loss, flops_budget, count(*)::DOUBLE AS n, min(m) AS m, min(x) AS low, max(x) AS high, sum(u*u) AS s2, sum(u*u*u) AS s3, sum(u*u*u*u) AS s4, sum(y) AS y0, sum(u*y) AS y1, sum(u*u*y) AS y2
    FROM u GROUP BY ALL HAVING count(DISTINCT x) >= 3),
  k AS (SELECT *, n*s2*s4 - n*s3*s3 - s2*s2*s2 AS det FROM q),
  ab AS (SELECT *, (n*s2*y2 - n*s3*y1 - s2*s2*y0) / det AS a, (n*s4*y1 - n*s3*y2 + s2*s3*y0 - s2*s2*y1) / det AS b0 FROM k),
  fit AS (SELECT *, (y0 - a*s2) / n AS c0 FROM ab),
  mn AS (SELECT loss, flops_budget, exp(m - b0 / (2*a)) AS n_opt, c0 - b0*b0 / (4*a) AS l_opt FROM fit WHERE a > 0 AND m - b0 / (2*a) BETWEEN low AND high),
  mins AS (SELECT *, flops_budget / (6 * n_opt) AS d_opt FROM mn),
  long AS (SELECT loss, flops_budget, 'n' AS what, n_opt AS v FROM mins UNION ALL SELECT loss, flops_budget, 'd', d_opt FROM mins UNION ALL SELECT loss, flops_budget, 'l', l_opt FROM mins),
  law AS (SELECT loss, what, count(*) AS points, regr_intercept(ln(v), ln(flops_budget)) AS lc, regr_slope(ln(v), ln(flops_budget)) AS e FROM long GROUP BY ALL),
  drops AS (SELECT i.loss, i.what, i.flops_budget, regr_slope(ln(j.v), ln(j.flops_budget)) AS e FROM long i JOIN long j ON i.loss = j.loss AND i.what = j.what AND i.flops_budget <> j.flops_budget GROUP BY ALL),
  jk AS (SELECT loss, what, count(*) AS points, CASE WHEN count(*) >= 3 THEN sqrt((count(*) - 1) * var_pop(e)) ELSE 'nan'::DOUBLE END AS se FROM drops GROUP BY ALL)"""
_HISTORY = """h AS (SELECT run_id, iter, m.* FROM (SELECT run_id, iter, unnest([arg_min(struct_pack(train_loss := train_loss, val_loss := val_loss, tokens_seen := tokens_seen), arrived_at)]) AS m
  FROM train_history GROUP BY run_id, iter))"""

QUERIES = {
    "tokenizer_report": (tokenizer_report, f"""WITH {DOCS}, c AS (SELECT lang, {WORDS} AS w, strlen(text) AS b, length(text) AS n FROM d WHERE text <> '' AND lang IS NOT NULL),
        t AS (SELECT lang, w, b, 'whitespace' AS tokenizer, w AS t FROM c UNION ALL SELECT lang, w, b, 'characters', n FROM c UNION ALL SELECT lang, w, b, 'bytes', b FROM c)
        SELECT tokenizer, coalesce(lang, 'overall') AS lang, sum(t)::BIGINT AS tokens, round(sum(t) / sum(w), 6) AS fertility, round(sum(b) / sum(t), 6) AS compression_ratio
        FROM t GROUP BY GROUPING SETS ((tokenizer, lang), (tokenizer))"""),
    "knee_vocab": (knee_vocab, f"""WITH {_OVERALL}, k AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER s AS n, min(r) OVER s AS lo, max(r) OVER s AS hi FROM o WINDOW s AS (PARTITION BY sample_id), w AS (PARTITION BY sample_id ORDER BY vocab_size)),
        e AS (SELECT *, CASE WHEN n > 1 AND hi > lo THEN (r - lo) / (hi - lo) - i / (n - 1) END AS d FROM k),
        z AS (SELECT *, coalesce(d >= lag(d) OVER w AND d >= lead(d) OVER w AND d > 1e-9, false) AS peak, d - 1 / (n - 1) AS t FROM e WINDOW w AS (PARTITION BY sample_id ORDER BY i)),
        f AS (SELECT p.sample_id, min(p.i) AS i FROM z p JOIN z q ON q.sample_id = p.sample_id AND q.i > p.i AND q.d < p.t AND p.peak
          WHERE NOT EXISTS (SELECT 1 FROM z x WHERE x.sample_id = p.sample_id AND x.peak AND x.i > p.i AND x.i < q.i) GROUP BY p.sample_id)
        SELECT z.sample_id, max(z.n) AS candidates, coalesce(max(vocab_size) FILTER (z.i = f.i), max(vocab_size) FILTER (z.i = n // 2)) AS chosen, max(f.i) IS NOT NULL AS knee FROM z LEFT JOIN f USING (sample_id) GROUP BY z.sample_id"""),
    "marginal_gain": (marginal_gain, f"WITH {_OVERALL} SELECT sample_id, vocab_size, round(100 * (r - lag(r) OVER w) / lag(r) OVER w, 6) AS gain FROM o WINDOW w AS (PARTITION BY sample_id ORDER BY vocab_size)"),
    "embedding_share": (embedding_share, f"""WITH {_SWEEP} SELECT DISTINCT vocab_size, round(vocab_size * {HIDDEN}.0 / {PARAMS}, 9) AS share,
        regexp_replace(regexp_replace(format('{{:.1f}}', round_even(vocab_size / 1000.0, 1)), '0$', ''), '\\.$', '') || 'k' AS label FROM v"""),
    "model_scale_share": (model_scale_share, f"""WITH {_SWEEP}, m(model, hidden, params) AS (VALUES {', '.join(f"('{a}', {b}, {c})" for a, b, c in MODELS)})
        SELECT DISTINCT model, vocab_size, round(vocab_size::BIGINT * hidden / params * 100, 6) AS percent FROM v, m"""),
    "vocab_pivot": (vocab_pivot, f"""WITH {_SWEEP} SELECT sample_id, vocab_size, max(compression_ratio) FILTER (lang = 'es') AS es, max(compression_ratio) FILTER (lang = 'hi') AS hi,
        max(compression_ratio) FILTER (lang = 'overall') AS overall, max(compression_ratio) FILTER (lang = 'pt') AS pt FROM v GROUP BY ALL"""),
    "vocab_sizes": (vocab_sizes, f"WITH {_SWEEP} SELECT vocab_size, count(DISTINCT sample_id) AS samples, count(*) FILTER (isnan(fertility)) AS unknown_fertility FROM v GROUP BY vocab_size"),
    "sweep_report": (sweep_report, f"""WITH {_SWEEP} SELECT sample_id, vocab_size, lang, '| ' || regexp_replace(regexp_replace(format('{{:.1f}}', round_even(vocab_size / 1000.0, 1)), '0$', ''), '\\.$', '') || 'k | ' || lang || ' | ' ||
        format('{{:.3f}}', fertility) || ' | ' || format('{{:.3f}}', compression_ratio) || ' |' AS line FROM v WHERE isfinite(fertility)"""),
    "baseline_ranks": (baseline_ranks, """WITH b AS (SELECT DISTINCT * FROM baseline_comparison) SELECT sample_id, lang, tokenizer, row_number() OVER (PARTITION BY sample_id, lang ORDER BY compression_ratio, tokenizer)::INT AS rank,
        round(max(CASE WHEN repo_id IS NULL THEN compression_ratio END) OVER (PARTITION BY sample_id, lang) / compression_ratio, 6) AS ours_to_this FROM b"""),
    "sample_sizes": (sample_sizes, """WITH t AS (SELECT DISTINCT * FROM sample_stats) SELECT sample_id, count(*) AS measurements, max(measured_at AT TIME ZONE 'UTC')::DATE AS last_day, sum(heldout_docs)::BIGINT AS heldout_docs FROM t GROUP BY sample_id"""),
    "shape_for_width": (shape_for_width, f"""WITH {_SHAPES}, h AS (SELECT width, n_layer, unnest(range(1, width + 1)) AS h FROM w)
        SELECT width, n_layer::INT AS n_layer, arg_min(h, abs(width / h::DOUBLE - 64) * 1000000 - h)::INT AS n_head FROM h WHERE width % h = 0 GROUP BY ALL"""),
    "param_counts": (param_counts, f"WITH {_SHAPES} SELECT width, {_PARAMS.format(w='width')} AS params, n_layer * (12::BIGINT * width * width + 13 * width) + 2 * width AS non_embedding FROM w"),
    "isoflop_grid": (isoflop_grid, f"WITH {_GRID} SELECT flops_budget, width, n_params, max_iters FROM grid"),
    "isoflop_pending": (isoflop_pending, f"""WITH {_OWN_GRID}, s AS (SELECT DISTINCT flops_budget, seed FROM isoflop_results)
        SELECT flops_budget, width, seed FROM grid JOIN s USING (flops_budget) EXCEPT SELECT flops_budget, width, seed FROM isoflop_results"""),
    "isoflop_elapsed": (isoflop_elapsed, f"""WITH {_RUNS}, {_OWN_GRID}, t AS (SELECT flops_budget, count(*) AS runs, round(sum(elapsed_s), 3) AS seconds FROM r SEMI JOIN grid USING (flops_budget, width) GROUP BY ALL), i AS (SELECT *, floor(seconds)::BIGINT AS s FROM t)
        SELECT flops_budget, runs, seconds, CASE WHEN s >= 3600 THEN printf('%dh%02dm%02ds', s // 3600, s % 3600 // 60, s % 60) WHEN s >= 60 THEN printf('%dm%02ds', s // 60, s % 60) ELSE printf('%ds', s) END AS duration FROM i"""),
    "budget_text": (budget_text, f"""WITH {_RUNS}, t AS (SELECT *, round_even(flops_budget / (6 * n_params), 0)::BIGINT AS d FROM r)
        SELECT run_id, format('{{:.3e}} FLOPs: width {{}}, {{}} layers, {{}} heads, {{:,}} parameters; {{:,}} tokens in {{:,}} steps of {BATCH} x {BLOCK}', flops_budget, n_embd, n_layer, n_head, n_params, d,
          greatest(1, round_even(d / {BATCH * BLOCK}, 0))::BIGINT) AS line, d FROM t"""),
    "flops_per_second": (flops_per_second, f"WITH {_RUNS} SELECT run_id, round(CASE WHEN elapsed_s > 0 THEN 6 * n_params::DOUBLE * tokens / elapsed_s END, 0) AS flops_per_second FROM r"),
    "nearest_width": (nearest_width, f"""WITH {_RUNS}, w AS (SELECT unnest(range(64, 8193, 64)) AS w), p AS (SELECT w, {_PARAMS.format(w='w')} AS p FROM w), t AS (SELECT DISTINCT n_params FROM r)
        SELECT n_params, w::INT AS width FROM t, p QUALIFY row_number() OVER (PARTITION BY n_params ORDER BY abs(p - n_params), w) = 1"""),
    "cell_means": (cell_means, f"WITH {_CELLS} SELECT flops_budget, width, runs, round(val_loss, 9) AS val_loss, round(train_loss, 9) AS train_loss, round(val_std, 7) AS val_std, n_params FROM c"),
    "cell_ranges": (cell_ranges, f"""WITH {_CELLS} SELECT round(min(1 - non_embedding / n_params), 9) AS least_share, round(max(1 - non_embedding / n_params), 9) AS most_share,
        round(min(val_std), 7) AS least_std, round(max(val_std), 7) AS most_std FROM c"""),
    "isoflop_parabola": (isoflop_parabola, f"WITH {_FITS} SELECT loss, flops_budget, n::BIGINT AS n, round(a, 4) AS a, round(b0 - 2*a*m, 4) AS b, round(c0 - b0*m + a*m*m, 4) AS c FROM fit"),
    "budget_minima": (budget_minima, f"WITH {_FITS} SELECT loss, flops_budget, round(ln(n_opt), 5) AS ln_n_opt, round(ln(d_opt), 5) AS ln_d_opt, round(l_opt, 5) AS l_opt FROM mins WHERE flops_budget >= 1e14"),
    "power_law": (power_law, f"WITH {_FITS} SELECT loss, what, points, round(lc, 5) AS ln_coefficient, round(e, 6) AS exponent FROM law"),
    "jackknife_se": (jackknife_se, f"WITH {_FITS} SELECT loss, what, points, round(se, 6) AS se FROM jk"),
    "exponent_agreement": (exponent_agreement, f"""WITH {_FITS}, p AS (SELECT what, abs(max(e) FILTER (loss = 'val') - max(e) FILTER (loss = 'train')) AS gap, sqrt(sum(se * se)) AS se FROM law JOIN jk USING (loss, what) GROUP BY what)
        SELECT what, round(gap, 5) AS gap, round(CASE WHEN isfinite(se) THEN se END, 5) AS se, CASE WHEN isnan(se) THEN NULL WHEN se > 0 THEN gap / se <= 2 ELSE gap <= 0 END AS agree FROM p"""),
    "recommendation": (recommendation, f"""WITH {_FITS}, b AS (SELECT what, round(lc + e * ln({FINAL_BUDGET!r}::DOUBLE), 4) AS ln_v, round(exp(lc + e * ln({FINAL_BUDGET!r}::DOUBLE)), 4) AS v FROM law WHERE loss = 'val' AND points >= 2),
        one AS (SELECT max(ln_v) FILTER (what = 'n') AS ln_n, max(ln_v) FILTER (what = 'd') AS ln_d, max(v) FILTER (what = 'l') AS l FROM b),
        w AS (SELECT unnest(range(64, 32769, 64)) AS w), nearest AS (SELECT w FROM w, one ORDER BY abs({_PARAMS.format(w='w')} - exp(ln_n)), w LIMIT 1),
        s AS (SELECT w::INT AS n_embd, {_LAYERS.format(w='w')}::INT AS n_layer, (SELECT arg_min(h, abs(w / h::DOUBLE - 64) * 1000000 - h) FROM unnest(range(1, w + 1)) AS r(h) WHERE w % h = 0)::INT AS n_head FROM nearest)
        SELECT ln_n, ln_d, l, n_layer, n_head, n_embd, '{{"ln_n":' || ln_n || ',"ln_d":' || ln_d || ',"l":' || l || ',"n_layer":' || n_layer || ',"n_head":' || n_head || ',"n_embd":' || n_embd || '}}' AS json FROM one, s"""),
    "best_val_so_far": (best_val_so_far, f"""WITH {_HISTORY}, v AS (SELECT run_id, iter, val_loss AS l FROM h WHERE val_loss IS NOT NULL AND NOT isnan(val_loss)),
        b AS (SELECT run_id, iter, min(l) OVER (PARTITION BY run_id ORDER BY iter) AS best FROM v) SELECT *, round(exp(best), 6) AS perplexity FROM b"""),
    "eval_loss_mean": (eval_loss_mean, f"""WITH {_HISTORY} SELECT run_id, count(*) AS evaluations, round(sum(CASE WHEN NOT isnan(train_loss) THEN train_loss::DECIMAL(18, 6) END)::DOUBLE / nullif(count(CASE WHEN NOT isnan(train_loss) THEN train_loss END), 0), 6) AS train_loss,
        round(sum(CASE WHEN NOT isnan(val_loss) THEN val_loss::DECIMAL(18, 6) END)::DOUBLE / nullif(count(CASE WHEN NOT isnan(val_loss) THEN val_loss END), 0), 6) AS val_loss, max(tokens_seen) AS tokens_seen FROM h GROUP BY run_id"""),
    "lr_schedule": (lr_schedule, f"""WITH k AS (SELECT DISTINCT run_id, iter FROM train_history WHERE iter IS NOT NULL), m AS (SELECT run_id, max(max_iters) AS most FROM isoflop_results GROUP BY run_id)
        SELECT run_id, iter, round(CASE WHEN iter < {LR['warmup']} THEN {LR['peak']}::DOUBLE * (iter + 1) / {LR['warmup']} WHEN iter >= most THEN {LR['low']}::DOUBLE
          ELSE {LR['low']}::DOUBLE + 0.5 * (1 + cos(pi() * (iter - {LR['warmup']}) / greatest(1, most - {LR['warmup']}))) * ({LR['peak']}::DOUBLE - {LR['low']}::DOUBLE) END, 12) AS lr FROM k JOIN m USING (run_id)"""),
}
