"""Mining of terms: a pool of standing terms, their frequency over time, bursts, trends and near duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.periods import month_of
from ..functions.text import CANDIDATE_PATTERN, ngrams, prefixes_and_parts, runs, smoothed_ratio, word_key
from ..session import materialize, small_enough

# Set phrases of minutes that are no subjects.
STOPWORDS = (
    "委員長", "委員会", "理事会", "本会議", "質疑", "答弁", "政府参考人", "国務大臣",
    "内閣総理大臣", "参考人", "衆議院", "参議院", "国会", "議員", "議長", "先生",
    "質問", "発言", "審議", "採決", "起立", "異議", "動議", "速記", "休憩", "散会",
    "予算委員会", "理事", "委員", "大臣", "政府", "総理", "皆様", "皆さん", "先ほど",
    "今回", "今後", "現在", "一つ", "二つ", "非常", "本当", "自分", "我々", "以上",
    "以下", "場合", "必要", "実際", "内容", "状況", "問題", "課題", "対応", "検討",
    "議案", "法案", "提出", "可決", "修正", "附帯決議", "報告", "説明", "資料",
    "閉会中", "閉会中審査", "委員派遣", "全体会議", "連合審査", "分科会", "継続審査",
)
# Offices that follow a person's name, that end a term, and that a term must not hold.
ROLE_SUFFIXES = ("内閣総理大臣", "国務大臣", "副大臣", "政務官", "委員長", "参考人", "総理", "内閣", "政権", "大臣", "委員", "議員", "先生", "知事", "長官", "局長", "次官")
ROLE_ENDINGS = ("議員", "委員", "大臣", "総理", "知事", "長官", "局長", "次官", "先生", "参考人", "政務官", "会長", "議長", "君", "氏")
ROLE_CONTAINS = ("委員長", "国務大臣", "副大臣", "政務官", "政府参考人", "内閣官房長官", "内閣総理大臣", "会長", "副議長")
# Patterns of years of an era, of numerals, and of quantities, which are no terms.
ERA_YEAR = "(令和|平成)[一二三四五六七八九十元0-9]+年"
NUMERALS_ONLY = "^[一二三四五六七八九十百千万零〇]+$"
QUANTITY = "^[一二三四五六七八九十百千万零〇元].*[年月日円兆億万時分間]"


def no_noise(term: Column) -> Column:
    """Neither a set phrase nor a number, quantity or honorific form."""
    return ~term.isin(*STOPWORDS) & ~term.rlike(NUMERALS_ONLY) & ~term.rlike(QUANTITY) & ~term.rlike("^[御ご]")


def keep_words(terms: DataFrame, speech: DataFrame, denied: list[str] = ()) -> DataFrame:
    """Terms (column ``term``) that are no set phrases, offices or parts of any speaker's name, alone or with an office."""
    term = F.col("term")
    kept = terms.where(~term.isin(*STOPWORDS, *denied) & ~term.rlike(f"({'|'.join(ROLE_ENDINGS)})$") & ~term.rlike("|".join(ROLE_CONTAINS)) & ~term.rlike(ERA_YEAR))
    names = speech.select("speaker").where("speaker IS NOT NULL").distinct()
    whole, _ = prefixes_and_parts(F.col("speaker"))
    parts = names.select(F.explode(whole).alias("part")).distinct()
    heads = F.array_distinct(F.concat(F.array(term), *[F.when(F.endswith(term, F.lit(r)) & (F.length(term) > len(r)), F.array(F.expr(f"left(term, length(term) - {len(r)})"))).otherwise(F.array().cast("array<string>")) for r in ROLE_SUFFIXES]))
    named = kept.select("term", F.explode(heads).alias("part")).join(parts, "part", "left_semi").select("term").distinct()
    return kept.join(named, "term", "left_anti")


def standing_terms(speech: DataFrame) -> DataFrame:
    """(term, standalone): speeches in which a term of two to four characters stands as a run of its own."""
    found = F.array_distinct(F.transform(F.filter(runs(F.col("body")), lambda r: F.length(r).between(2, 4)), word_key))
    return speech.select(F.explode(found).alias("term")).groupBy("term").agg(F.count("*").alias("standalone"))


def pool(standing: DataFrame, least: int = 50, least_two: int = 5) -> DataFrame:
    return standing.where(F.col("standalone") >= F.when(F.length("term") == 2, least_two).otherwise(least))


def windows_of(body: Column) -> Column:
    """Distinct windows of two to four characters of a text's runs."""
    cut = lambda r: F.concat(ngrams(word_key(r), 2), ngrams(word_key(r), 3), ngrams(word_key(r), 4))
    return F.array_distinct(F.flatten(F.transform(runs(body), cut)))


def frequencies(speech: DataFrame, meeting: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, month, session, n): speeches that hold a pool term anywhere in a run. Sums over months or sessions are exact.

    Windows are made distinct inside each text before anything moves, and combine by term, month and session before the shuffle.
    """
    rows = speech.select("issue_id", "date", "body").join(meeting.select("issue_id", "session"), "issue_id")
    cut = rows.select(month_of(F.col("date")).alias("month"), "session", F.explode(windows_of(F.col("body"))).alias("term"))
    kept = terms.select("term")
    if small_enough(kept.count(), 64):
        # While the pool fits every task, windows outside it end before they are counted.
        return cut.join(F.broadcast(kept), "term", "left_semi").groupBy("term", "month", "session").agg(F.count("*").alias("n"))
    return cut.groupBy("term", "month", "session").agg(F.count("*").alias("n")).join(kept, "term", "left_semi")


def denominators(speech: DataFrame, meeting: DataFrame) -> DataFrame:
    """(month, session, n_speeches, first, last)."""
    rows = speech.join(meeting.select("issue_id", "session"), "issue_id")
    return rows.groupBy(month_of(F.col("date")).alias("month"), "session").agg(F.count("*").alias("n_speeches"), F.min("date").alias("first"), F.max("date").alias("last"))


def fragments(standing: DataFrame, totals: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Two-letter terms that mostly occur inside longer abbreviations."""
    both = totals.where((F.length("term") == 2) & (F.col("term") >= "Ａ")).join(standing, "term", "left")
    return both.where(F.coalesce(F.col("standalone"), F.lit(0)) / F.col("n") < ratio).select("term")


def _upper_median(rates: Column) -> Column:
    return F.element_at(F.sort_array(rates), (F.floor(F.size(rates) / 2) + 1).cast("int"))


def yearly(cells: DataFrame, volumes: dict[str, float], per: float) -> DataFrame:
    """(term, n, rates): ``cells`` are (term, year, n); rates hold every year, also those without the term."""
    years = sorted(volumes)
    sums = [F.sum(F.when(F.col("year") == y, F.col("n")).otherwise(0)).alias(f"_{y}") for y in years]
    rates = F.array(*[F.col(f"_{y}") / F.lit(float(volumes[y])) * per for y in years])
    counts = F.array(*[F.col(f"_{y}") for y in years])
    return cells.groupBy("term").agg(F.sum("n").alias("n"), *sums).select("term", "n", rates.alias("rates"), counts.alias("counts"))


def bursts(profile: DataFrame, years: list[str]) -> DataFrame:
    """burst: the best year against the upper median year; recency: the last year against it; peak_year: the first best year."""
    best = F.array_max("rates")
    at = F.array_position("rates", best).cast("int")
    return profile.withColumns({"burst": smoothed_ratio(best, _upper_median(F.col("rates"))), "recency": smoothed_ratio(F.element_at("rates", -1), _upper_median(F.col("rates"))), "peak_year": F.element_at(F.array(*[F.lit(y) for y in years]), at), "peak_n": F.element_at("counts", at)})


def near_duplicates(ranked: DataFrame, ratio: float) -> DataFrame:
    """Terms (term, n) that lie inside a longer one which is nearly as frequent; longer terms are cut into parts and joined by equality."""
    parts = ranked.where(F.length("term") > 2).select(F.col("n").alias("_n"), F.col("term").alias("_long"), F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.length("term") - 1)), lambda k: ngrams(F.col("term"), k))))).alias("term")).where("term <> _long")
    return ranked.join(parts, "term").where(F.col("_n") >= F.col("n") * ratio).select("term").distinct()


def frequent_words(speech: DataFrame, meeting: DataFrame, everyone: DataFrame, top: int = 500, least: int = 300, least_standing: int = 50, least_standing_two: int = 5, duplicate_ratio: float = 0.75, fragment_ratio: float = 0.5, denied: list[str] = ()) -> DataFrame:
    """(term, n, burst, peak): the terms that burst most, without noise, fragments and near duplicates; ties by term.

    ``speech`` is the indexed population, ``everyone`` gives the names. peak is the first month with the highest share of speeches.
    """
    standing = materialize(standing_terms(speech))
    cells = materialize(frequencies(speech, meeting, pool(standing, least_standing, least_standing_two)))
    months = {r.month: r.n for r in denominators(speech, meeting).groupBy("month").agg(F.sum("n_speeches").alias("n")).collect()}
    totals = cells.groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    eligible = keep_words(totals.where(no_noise(F.col("term"))), everyone, denied).join(fragments(standing, totals, fragment_ratio), "term", "left_anti").select("term")
    volumes: dict[str, float] = {}
    for m, n in months.items():
        volumes[m[:4]] = volumes.get(m[:4], 0) + n
    by_year = cells.join(eligible, "term", "left_semi").groupBy("term", F.substring("month", 1, 4).alias("year")).agg(F.sum("n").alias("n"))
    profile = bursts(yearly(by_year, volumes, 1000), sorted(volumes)).select("term", "n", "burst")
    head = materialize(profile.orderBy(F.desc("burst"), "term").limit(top * 3))
    words = head.join(near_duplicates(head, duplicate_ratio), "term", "left_anti").orderBy(F.desc("burst"), "term").limit(top)
    share = F.create_map(*[x for m, n in sorted(months.items()) for x in (F.lit(m), F.lit(float(n)))])
    monthly = cells.join(F.broadcast(words.select("term")), "term", "left_semi").groupBy("term", "month").agg(F.sum("n").alias("k"))
    peak = monthly.groupBy("term").agg(F.min(F.struct((-F.col("k") / F.element_at(share, F.col("month"))).alias("r"), "month")).alias("_p")).select("term", F.col("_p.month").alias("peak"))
    return words.join(peak, "term", "left")


def session_counts(cells: DataFrame, words: DataFrame) -> DataFrame:
    """(term, session, hits) of chosen words."""
    return cells.join(words.select("term"), "term", "left_semi").groupBy("term", "session").agg(F.sum("n").alias("hits"))


def proposals(speech: DataFrame, everyone: DataFrame, least: int = 200, least_peak: int = 100, denied: list[str] = ()) -> DataFrame:
    """Candidate terms with their occurrences, burst, recency and peak year; rates are per million runs of a year."""
    found = speech.select(F.date_format("date", "yyyy").alias("year"), F.explode(runs(F.col("body"), CANDIDATE_PATTERN)).alias("term")).groupBy("term", "year").agg(F.count("*").alias("n"))
    volumes = {r.year: r.n for r in found.groupBy("year").agg(F.sum("n").alias("n")).collect()}
    profile = bursts(yearly(found, volumes, 1e6), sorted(volumes)).where(F.col("n") >= least)
    return keep_words(profile, everyone, denied).select("term", "n", "burst", "recency", "peak_year", "peak_n", (F.col("peak_n") >= least_peak).alias("burstable"))


def proposal_lists(found: DataFrame, most: int = 100, current: int = 60, frequent: int = 200) -> DataFrame:
    """(list, rank, term): the most bursting, those peaking in the last year by recency, and the most frequent; ties by term."""
    last = found.agg(F.max("peak_year")).first()[0]
    parts = [("burst", found.where("burstable"), "burst", most), ("current", found.where(F.col("burstable") & (F.col("peak_year") == last)), "recency", current), ("frequent", found, "n", frequent)]
    out = None
    for name, rows, key, k in parts:
        top = rows.orderBy(F.desc(key), "term").limit(k)
        part = top.select(F.lit(name).alias("list"), F.row_number().over(Window.orderBy(F.desc(key), "term")).alias("rank"), "term")
        out = part if out is None else out.unionByName(part)
    return out


def trend_windows(speech: DataFrame, everyone: DataFrame, days: int = 5, windows: int = 8, top: int = 20, least: int = 15, denied: list[str] = ()) -> DataFrame:
    """(window, from_date, until, sitting_days, n_speeches, rank, term, n, lift) over windows of sitting days, newest first.

    lift compares a term's share of the window's runs with its share of all runs, one added to its count.
    """
    by_date = materialize(speech.select("date", F.explode(runs(F.col("body"), CANDIDATE_PATTERN)).alias("term")).groupBy("date", "term").agg(F.count("*").alias("n")))
    sittings = by_date.select("date").distinct().withColumn("_r", F.row_number().over(Window.orderBy(F.desc("date"))) - 1).select("date", F.floor(F.col("_r") / days).cast("int").alias("window")).where(F.col("window") < windows)
    spans = sittings.groupBy("window").agg(F.min("date").alias("from_date"), F.max("date").alias("until"), F.count("*").alias("sitting_days"))
    speeches = speech.groupBy("date").agg(F.count("*").alias("_k")).join(F.broadcast(sittings), "date").groupBy("window").agg(F.sum("_k").alias("n_speeches"))
    inside = by_date.join(F.broadcast(sittings), "date").groupBy("window", "term").agg(F.sum("n").alias("n"))
    totals = inside.groupBy("window").agg(F.sum("n").alias("_total"))
    base = by_date.groupBy("term").agg(F.sum("n").alias("_base"))
    all_runs = float(by_date.agg(F.sum("n")).first()[0] or 0)
    eligible = keep_words(inside.where(F.col("n") >= least).select("term").distinct(), everyone, denied)
    lifted = inside.where(F.col("n") >= least).join(eligible, "term", "left_semi").join(base, "term").join(F.broadcast(totals), "window").withColumn("lift", (F.col("n") / F.col("_total")) / ((F.col("_base") + 1) / F.lit(all_runs)))
    ranked = lifted.withColumn("rank", F.row_number().over(Window.partitionBy("window").orderBy(F.desc("lift"), "term"))).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(spans), "window").join(F.broadcast(speeches), "window").select("window", "from_date", "until", "sitting_days", "n_speeches", "rank", "term", "n", "lift")


def new_terms(trend: DataFrame, known: list[str]) -> DataFrame:
    """Trending terms that are in no topic: occurrences, best lift, and the windows they came up in."""
    fresh = trend.where(~F.col("term").isin(*known)) if known else trend
    return fresh.groupBy("term").agg(F.sum("n").alias("n"), F.max("lift").alias("lift"), F.array_sort(F.collect_list(F.date_format("from_date", "yyyy-MM-dd"))).alias("windows"))


def topic_candidates(trend: DataFrame, frequent: DataFrame, known: list[str], most: int = 60) -> DataFrame:
    """Trending terms, then frequent ones, without known forms; a term's first place counts."""
    both = trend.groupBy("term").agg(F.max("lift").alias("score")).withColumn("source", F.lit(0)).unionByName(frequent.select("term", F.col("burst").alias("score"), F.lit(1).alias("source")))
    first = both.where(~F.col("term").isin(*known)).groupBy("term").agg(F.min(F.struct("source", (-F.col("score")).alias("s"))).alias("_f"))
    return first.select("term", F.col("_f.source").alias("source"), (-F.col("_f.s")).alias("score")).orderBy("source", F.desc("score"), "term").limit(most)
