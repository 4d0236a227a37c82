"""Problem 1: quantities recorded in different units.

Every number of a transaction comes from a *source statement*: the feed it came through (and, where the feed's note
names a date, the side of that date), the side (paid or received) and what its currency text says, or else what the
memo says about the unit. The operator

1. links records of the same quantity across sources: the two sides of one payment, and two deliveries of one payment;
2. estimates for every pair of sources a robust scale (median of log ratios) and offset (median residual, which every known
   conversion wants to be as good as 0);
3. propagates scales through the graph of sources, starting from the sources that state a whole unit by its usual name;
4. snaps each scale to a known conversion: the value of one whole unit times a power of ten. What a text says in words
   picks the currency, and stands in for the estimate only where no linked records support one;
5. converts every number. A sum the memo writes out in full takes the place of the number beside it.

Defined cases. Null amount: no result on that side. Null currency: the currency (and the feed's unit for it) whose
conversion explains the other side's dollars best; where that fails, the unit most of the feed's currencies have, and
no dollars. Null memo or feed: that source says nothing. Zero: no evidence on scale, converted like any number.
Empty table: empty result. Repeated rows: each keeps its result. Extra columns are ignored; names given are needed.
"""

from __future__ import annotations

import heapq
import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, table

# Words for currencies, by code.
CURRENCY_WORDS = {
    "USD": r"usd|us\$|\$ ?us|u\.s\. dollars?|us dollars?|dollar \(us\)|dollars?|usc|us cents?|¢ us",
    "EUR": r"eur|euros?|€|d'euros|eurocents?|teur",
    "GBP": r"gbp|gbx|uk pounds?|pounds? sterling|£|pence|uk pence",
    "CNY": r"cny|cn¥|rmb|yuan|renminbi|fen|jiao|wan",
    "JPY": r"jpy|jp¥|yen|japanese yen",
    "INR": r"inr|rupees?|₹|rs\.|paise|paisa|lakh|crore",
    "CHF": r"chf|swiss francs?|franken|sfr\.?|rappen|centimes|tchf",
    "RUB": r"rub|rubles?|₽|руб\.?|kopecks?|коп\.?|копе\w+",
    "MXN": r"mxn|mx\$|mexican pesos?|pesos?|centavos|mdp",
    "KWD": r"kwd|kd|kuwaiti dinars?|dinars?|fils",
    "BTC": r"btc|xbt|bitcoins?|₿|satoshis?|sats?|bits",
}
# Words for units, and the power of ten by which a number in them exceeds one in whole units.
SMALL_UNITS = [
    (r"satoshis?|sats?", 8),
    (r"bits|µbtc|μbtc|micro\w*", 6),
    (r"mbtc|milli-?bitcoins?", 3),
    (r"fils", 3),
    (r"jiao", 1),
    (r"cents?|ct|usc|¢|eurocents?|pence|gbx|rappen|centimes|fen|paise|paisa|kopecks?|коп\.?|копе\w+|centavos|p", 2),
]
LARGE_UNITS = [
    (r"crore", -7),
    (r"mn|millions?|mio\.?|млн\.?|mdp", -6),
    (r"lakh", -5),
    (r"10k|wan|man", -4),
    (r"thousands?|'000|x1000|tsd\.?|milliers|miles|тыс\.?|k|tausend\w*|teur|tchf", -3),
]
# Words that say which side of a payment a memo speaks of.
SIDE_WORDS = {
    "paid": r"paid|payer|payé|debit|debited|gezahlt|gezahlter",
    "received": r"received|payee|reçu|credit|credited|erhalten|empfangener",
}
MINOR = r"minor units"

#: Links that must support an estimate before it overrules what the text says.
MIN_LINKS = 3
#: How far from a known conversion, in powers of ten, an estimate may lie.
SNAP = 0.02
#: Sources are spellings and feeds, not records; more than this many means the texts are not unit statements.
MAX_SOURCES = 200_000
#: Pairs of sources that agree with known conversions, all of which the driver holds as numbers; more than this many
#: raises, and none is left out.
MAX_PAIRS = 5_000_000


# How notes of feeds speak of units; only read for sources that too few records link.
NOTE_UNITS = [(r"minor units?", "minor"), (r"hundertstel\w*|hundredths?|centièmes", 2), (r"(?:in|en) (?:thousands|milliers|tausend\w*)", -3), (r"(?:in|en) (?:millions|millionen)", -6)]
NOTE_SIDES = {"p": r"paid|pay[ée]e?s?|gezahlt\w*", "r": r"received|re[çc]ue?s?|empfangen\w*|erhalten\w*"}


def read_note(note: str | None, side: str, part: str, minor_digits: dict[str, int]) -> dict[str, int]:
    """Powers of ten by currency code that a feed's note states for a side ("p", "r") before or after its date ("<", ">")."""
    out: dict[str, int] = {}
    if not note or part == ">":
        return out
    for clause in re.split(r"[;,]|\.\s", note.lower()):
        named = [k for k, w in NOTE_SIDES.items() if _has(w, clause)]
        if named and side not in named:
            continue
        if _has(r"satoshis?", clause):
            out["BTC"] = 8
        for words, power in NOTE_UNITS:
            if _has(words, clause):
                out.update({c: d if power == "minor" else power for c, d in minor_digits.items()})
    return out


def _has(words: str, text: str) -> bool:
    return re.search(rf"(?<![^\W_])(?:{words})(?![^\W_])", text) is not None


def read_unit(text: str | None, minor_digits: dict[str, int], names: dict[str, str]) -> tuple[str | None, int | None]:
    """(currency code, power of ten) that a text states; None where it states none.

    names: usual names and codes in lower case, to codes. The power is 0 for whole units, 2 for cents, -3 for thousands.
    """
    if text is None or not text.strip():
        return None, None
    raw = text.strip()
    low = raw.lower().replace("’", "'")
    if low in names and raw != "GBp":
        return names[low], 0
    spaced = re.sub(r"(?<=[£€₿$₹₽¥])(?=\w)|(?<=\w)(?=[£€₿₹₽])", " ", low)
    spaced = re.sub(r"\bk(?=(usd|eur|gbp|chf|jpy|cny|inr|rub|mxn|kwd|btc)\b)", "k ", spaced)
    spaced = re.sub(r"\bm(?=btc\b)", "milli-bitcoin ", spaced)
    spaced = re.sub(r"[µμ](?=btc\b)", "micro ", spaced)
    spaced = re.sub(r"(?<=[£€]) ?m\b", " mn", spaced).replace("d'euros", "euros").replace("man-yen", "man yen")
    code = next((c for c, w in CURRENCY_WORDS.items() if any(_has(re.escape(n), spaced) for n, k in names.items() if k == c)), None)
    code = code or next((c for c, w in CURRENCY_WORDS.items() if _has(w, spaced) or re.search(rf"(?:^|\s)(?:{w})(?:\s|$)", spaced)), None)
    if raw == "GBp":
        return "GBP", 2
    if code is None:
        return None, None
    if MINOR in low:
        return code, minor_digits.get(code, 2)
    for words, power in [*SMALL_UNITS, *LARGE_UNITS]:
        if re.search(rf"(?<![^\W_])(?:{words})(?![^\W_])", spaced) or re.search(rf"(?:^|\s|\()(?:{words})(?:\s|\)|$)", spaced):
            return code, power
    return code, 0


def _clean(name: str) -> Column:
    c = F.trim(F.col(name))
    return F.when(F.length(c) > 0, c)


def _clause(side: str) -> Column:
    """The clause of the memo that speaks of the side, empty where none does."""
    return F.regexp_extract(F.col("memo"), rf"(?i)(?:^|;)([^;]*?(?<![\p{{L}}])(?:{SIDE_WORDS[side]})(?![\p{{L}}])[^;]*)", 1)


def statements(trans: DataFrame, feeds: DataFrame) -> DataFrame:
    """trans with, for each side, its source and the sum the memo writes out: {paid,received}_{src,sum,x,cur,regime}.

    Memos that speak of a side take a path of their own. Their patterns make the generated code too long for the JVM to
    compile, which would then be interpreted for every row.
    """
    speaks = F.coalesce(F.col("memo").rlike(rf"(?i)(?<![\p{{L}}])(?:{'|'.join(SIDE_WORDS.values())})(?![\p{{L}}])"), F.lit(False))
    return _stated(trans.where(~speaks), feeds, False).unionByName(_stated(trans.where(speaks), feeds, True))


def _stated(trans: DataFrame, feeds: DataFrame, memos: bool) -> DataFrame:
    date = F.regexp_extract("note", r"(\d{1,2})\.(\d{1,2})\.(\d{4})", 0)
    iso = F.regexp_extract("note", r"\d{4}-\d{2}-\d{2}", 0)
    turns = feeds.select(
        F.col("feed_id").alias("_feed"),
        F.coalesce(F.to_date(F.when(iso != "", iso)), F.to_date(F.when(date != "", date), "d.M.yyyy")).alias("_turn"),
    ).where("_turn is not null").groupBy("_feed").agg(F.min("_turn").alias("_turn"))
    # trans_feeds is a fixed table of a dozen rows; Spark still decides the join by its size
    df = trans.join(turns, F.col("feed_id") == F.col("_feed"), "left")
    part = F.when(F.col("_turn").isNull(), F.lit("")).when(F.to_date("timestamp") <= F.col("_turn"), F.lit("<")).otherwise(F.lit(">"))
    out = df
    for side in ("paid", "received"):
        base = F.concat_ws("|", F.lit("T"), F.coalesce(F.col("feed_id").cast("string"), F.lit("")), part, F.lit(side[0]))
        typed = F.concat_ws("|", base, F.coalesce(_clean(f"currency_{side}"), F.lit("")))
        out = out.withColumn(f"{side}_x", F.col(f"amount_{side}")).withColumn(f"{side}_cur", _clean(f"currency_{side}")).withColumn(f"{side}_regime", base)
        if not memos:
            out = out.withColumn(f"{side}_sum", F.lit(None).cast("double")).withColumn(f"{side}_src", typed)
            continue
        out = out.withColumn(f"_{side}_clause", _clause(side))
        c = F.col(f"_{side}_clause")
        digits = F.regexp_extract(c, r"(?<![\p{L}\p{N}'])(\d(?:[\d.,\s   '’]*\d)?)(?![\p{L}\p{N}])", 1)
        unit = F.when(c == "", F.lit("")).otherwise(F.trim(F.regexp_extract(c, r"(?:\b(?:in|en|as)\b|=)\s+([^,;]{1,60}?)\s*(?:,|$)", 1)))
        bare = F.regexp_replace(digits, r"[\s   '’]", "")
        last = F.regexp_extract(bare, r"([.,])(\d+)$", 2)
        both = bare.contains(".") & bare.contains(",")
        many = F.length(F.regexp_replace(bare, r"[^.,]", "")) > 1
        three = (F.length(last) == 3) & ~c.rlike(r"(?i)kwd|dinar|\bkd\b|btc|bitcoin|xbt|₿")
        whole = F.regexp_replace(bare, "[.,]", "")
        decimal = F.concat(F.regexp_replace(F.regexp_replace(bare, r"[.,]\d+$", ""), "[.,]", ""), F.lit("."), last)
        value = F.when(last == "", whole).when(both, decimal).when(many | three, whole).otherwise(decimal)
        said = (unit == "") & (digits != "")
        out = out.withColumn(f"{side}_sum", F.when((c != "") & said, value.try_cast("double"))).withColumn(f"{side}_src", F.when(unit != "", F.concat(F.lit("M|"), F.lower(unit))).otherwise(typed))
    return out.drop("_paid_clause", "_received_clause", "_feed", "_turn")


def links(stated: DataFrame) -> DataFrame:
    """Pairs of records of one quantity: (u, v, r = log10 x_u / x_v, m = log10 x_v), from both sides and from deliveries."""

    def usable(side: str, at: str = "") -> Column:
        return (F.col(f"{at}{side}_x") > 0) & F.col(f"{at}{side}_sum").isNull() & (F.col(f"{at}{side}_cur").isNotNull())

    narrow = stated.select(
        F.xxhash64("timestamp", "from_bank", F.upper(F.trim("from_account")), "to_bank", F.upper(F.trim("to_account"))).alias("_k"),
        "trans_id",
        F.when(usable("paid"), F.col("paid_src")).alias("_pu"), F.when(usable("paid"), F.log10("paid_x")).cast("float").alias("_px"),
        F.when(usable("received"), F.col("received_src")).alias("_ru"), F.when(usable("received"), F.log10("received_x")).cast("float").alias("_rx"),
    )
    # one shuffle of the narrow rows serves both kinds of link: the nearest delivery before it in the same group that has a number on that side
    w = Window.partitionBy("_k").orderBy("trans_id").rowsBetween(Window.unboundedPreceding, -1)
    near = narrow.where("_pu is not null or _ru is not null").select("*", *(F.last(c, ignorenulls=True).over(w).alias(f"_b{c}") for c in ("_pu", "_px", "_ru", "_rx")))
    pairs = F.array(
        F.struct(F.col("_pu").alias("u"), F.col("_ru").alias("v"), (F.col("_px") - F.col("_rx")).alias("r"), F.col("_rx").alias("m"), F.lit(0).alias("kind")),
        F.struct(F.col("_pu").alias("u"), F.col("_b_pu").alias("v"), (F.col("_px") - F.col("_b_px")).alias("r"), F.col("_b_px").alias("m"), F.lit(1).alias("kind")),
        F.struct(F.col("_ru").alias("u"), F.col("_b_ru").alias("v"), (F.col("_rx") - F.col("_b_rx")).alias("r"), F.col("_b_rx").alias("m"), F.lit(1).alias("kind")),
    )
    return near.select(F.inline(F.filter(pairs, lambda p: p["u"].isNotNull() & p["v"].isNotNull() & (p["u"] != p["v"]))))


def pair_estimates(linked: DataFrame) -> DataFrame:
    """(u, v, links, scale10, offset, level): x_u is about 10 ** scale10 * x_v + offset, each robust; level: the median log of x_v."""
    cells = linked.groupBy("u", "v", F.round(F.col("r") * 500).cast("int").alias("b"), F.floor("m").cast("int").alias("d")).agg(F.count("*").alias("n"))
    scale = cells.groupBy("u", "v").agg(F.expr("percentile(b, 0.5, n)").alias("_b"), F.sum("n").alias("links"))
    mid = F.pow(F.lit(10.0), F.col("d") + 0.5)
    return (
        cells.join(scale, ["u", "v"])
        .withColumn("_res", (F.pow(F.lit(10.0), F.col("b") / 500) - F.pow(F.lit(10.0), F.col("_b") / 500)) * mid)
        .groupBy("u", "v").agg((F.first("_b") / 500).alias("scale10"), F.first("links").alias("links"), F.expr("percentile(_res, 0.5, n)").alias("offset"), (F.expr("percentile(d, 0.5, n)") + 0.5).alias("level"))
    )


def _readings(spark: SparkSession, units: DataFrame) -> tuple[dict[str, int], dict[str, str], dict[str, float]]:
    rows = units.limit(10_001).collect()  # one row per currency
    if len(rows) > 10_000:
        raise ValueError("currency_units has more rows than there are currencies")
    minor = {r["iso_code"]: int(r["minor_digits"]) for r in rows if r["iso_code"]}
    names = {n.lower(): r["iso_code"] for r in rows for n in (r["currency"], r["iso_code"]) if n}
    usd = {r["iso_code"]: float(r["usd_per_unit"]) for r in rows if r["iso_code"] and r["usd_per_unit"]}
    return minor, names, usd


def source_graph(stated: DataFrame, feeds: DataFrame, units: DataFrame) -> DataFrame:
    """One row per source: (source, regime, text, code, power, log_usd, links, estimated, offset, said).

    power: the number counts whole units of the currency times 10 ** power. estimated: taken from linked records.
    """
    spark = stated.sparkSession
    minor, names, usd = _readings(spark, units)
    both = stated.select(F.explode(F.array(
        F.struct(F.col("paid_src").alias("source"), F.col("paid_cur").alias("text"), F.col("paid_regime").alias("regime")),
        F.struct(F.col("received_src").alias("source"), F.col("received_cur").alias("text"), F.col("received_regime").alias("regime")),
    )).alias("s")).select("s.*")
    rows = both.groupBy("source").agg(F.min("text").alias("text"), F.min("regime").alias("regime"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: the currency texts or memos state no units")
    read = {}
    for r in rows:
        said = r["source"][2:] if r["source"].startswith("M|") else r["text"]
        read[r["source"]] = read_unit(said, minor, names)
    # whole units under their usual name, in a feed whose note is silent, are the fixed points
    notes = _notes(feeds)
    silent = {f for f, note in notes.items() if not note}
    anchors = [
        r["source"]
        for r in rows
        if r["source"].startswith("T|") and (r["text"] or "").lower() in names and read[r["source"]][0] in usd and read[r["source"]][1] == 0
        and (not silent or r["source"].split("|")[1] in silent)
    ]
    # every pair counts, weak ones too: those through the few feeds that hold fixed points are often the weakest
    order = sorted(read)
    number = {s: i for i, s in enumerate(order)}
    worth = [math.log10(usd[read[s][0]]) if read[s][0] in usd else None for s in order]
    pairs = cut(pair_estimates(links(stated)))
    # of each source, as a line over the source it has most links with: x_v = (x_u - offset) / 10 ** scale10 the other way
    turned = pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "links", (-F.col("offset") / F.pow(F.lit(10.0), F.col("scale10"))).alias("offset"))
    strongest = pairs.select("u", "v", "links", "offset").unionByName(turned).groupBy("u").agg(F.min_by("offset", F.struct(-F.col("links"), F.col("v"))).alias("offset"))
    offsets = {r["u"]: r["offset"] for r in strongest.collect()}  # one row per source
    # powers of ten by which v's number exceeds u's: whole, whatever u turns out to be, or the pair leads to no known conversion;
    # and no known conversion has an offset, so the pair's must be as good as none beside its numbers
    at = spark.createDataFrame([(s, number[s], x) for s, x in zip(order, worth) if x is not None], "source string, id int, worth double")
    ends = [F.broadcast(at.select(F.col("source").alias(c), F.col("id").alias(f"_{c}"), F.col("worth").alias(f"_{c}w"))) for c in ("u", "v")]
    step = F.col("_vw") - F.col("_uw") - F.col("scale10")
    snapped = pairs.join(ends[0], "u").join(ends[1], "v").where((F.abs(step - F.round(step)) <= SNAP) & (F.abs("offset") <= (10**SNAP - 1) * F.pow(F.lit(10.0), F.col("level") + F.col("scale10")))).select("_u", "_v", F.round(step).cast("int").alias("step"), "links")
    got = snapped.limit(MAX_PAIRS + 1).toArrow()
    if got.num_rows > MAX_PAIRS:
        raise ValueError(f"more than {MAX_PAIRS} linked pairs of sources: the currency texts or memos state no units")
    known = {order[i]: k for i, k in _propagate({number[s] for s in anchors}, len(order), *(c.to_numpy() for c in got.columns)).items()}
    out, same_code, votes, support = [], {}, {}, {}
    for r in rows:
        s, (code, said) = r["source"], read[r["source"]]
        power, n = known.get(s, (None, 0))
        out.append((s, r["regime"], r["text"], code, power, said, n))
        if power is not None and s.startswith("T|") and said == 0:
            if n >= MIN_LINKS:
                same_code.setdefault((r["regime"], code), power)
            support[r["regime"]] = support.get(r["regime"], 0) + n
            v = votes.setdefault(r["regime"], {})
            if n >= MIN_LINKS:  # a source a vote
                v[power] = v.get(power, 0) + 1
                if power == minor.get(code):
                    v["minor"] = v.get("minor", 0) + 1
    rule = {g: max(v, key=lambda k: (v[k], k != "minor")) for g, v in votes.items() if v}
    final = []
    for s, regime, text, code, power, said, n in out:
        sure = power is not None and n >= MIN_LINKS
        if not sure:
            # too few links: what the text says, or else what its feed does with this currency, or with most currencies
            feed, part, side = regime.split("|")[1:4]
            if regime in rule and support[regime] >= 4 * MIN_LINKS:
                usual = minor.get(code, 0) if rule[regime] == "minor" else rule[regime]
            else:
                usual = read_note(notes.get(feed), side, part, minor).get(code, 0)
            power = said if s.startswith("M|") or said != 0 else same_code.get((regime, code), usual)
        final.append((s, regime, text, code, power, math.log10(usd[code]) if code in usd else None, min(n, 1 << 40), sure, float(offsets.get(s) or 0.0), said))
    return spark.createDataFrame(final, "source string, regime string, text string, code string, power int, log_usd double, links long, estimated boolean, offset double, said int")


def _propagate(anchors: set[int], size: int, u: np.ndarray, v: np.ndarray, step: np.ndarray, links: np.ndarray) -> dict[int, tuple[int, int]]:
    """Power and support of each source that pairs lead to from the anchors, which have power 0; strongest support first.

    The power of v is that of u and the step; a pair leads both ways. A link counts for as much as the support of the
    source it starts from. Sources are numbered 0 to size.
    """
    start = np.concatenate([u, v])
    by = np.argsort(start, kind="stable")
    at = np.searchsorted(start[by], np.arange(size + 1))
    to, steps, weight = np.concatenate([v, u])[by], np.concatenate([step, -step])[by], np.concatenate([links, links])[by]
    known = {s: (0, 1 << 40) for s in anchors}
    votes: dict[int, dict[int, int]] = {}
    heap: list[tuple[int, int, int]] = []
    fresh = sorted(known)
    while True:
        for s in fresh:
            power, width = known[s]
            near = slice(at[s], at[s + 1])
            for t, d, n in zip(to[near].tolist(), steps[near].tolist(), weight[near].tolist()):
                if t in known:
                    continue
                k = power + d
                got = votes.setdefault(t, {})
                got[k] = got.get(k, 0) + min(n, width)
                heapq.heappush(heap, (-got[k], t, -k))
        while heap and heap[0][1] in known:
            heapq.heappop(heap)
        if not heap:
            return known
        n, t, k = heapq.heappop(heap)
        known[t] = (-k, -n)
        fresh = [t]


def _notes(feeds: DataFrame) -> dict[str, str]:
    rows = feeds.select("feed_id", "note").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("trans_feeds has one row per feed")
    return {str(r["feed_id"]): (r["note"] or "").strip() for r in rows}


def convert(stated: DataFrame, graph: DataFrame) -> DataFrame:
    """stated with {side}_power, {side}_code and {side}_usd for both sides."""
    by = graph.select("source", F.col("power"), F.col("code"), F.col("log_usd"))
    usual = (
        graph.where("source like 'T|%' and said = 0 and power is not null and log_usd is not null")
        .groupBy("regime").agg(
            F.array_distinct(F.collect_list(F.struct((F.col("power") - F.col("log_usd")).alias("off"), F.col("power").alias("power"), F.col("code").alias("code"), F.col("log_usd").alias("log_usd")))).alias("_cands"),
            F.mode("power", True).alias("_mode"),
        )
    )
    df = stated
    for side in ("paid", "received"):
        df = (
            df.join(F.broadcast(by.select(F.col("source").alias(f"{side}_src"), F.col("power").alias(f"_{side}_p"), F.col("code").alias(f"_{side}_c"), F.col("log_usd").alias(f"_{side}_l"))), f"{side}_src", "left")
            .join(F.broadcast(usual.select(F.col("regime").alias(f"{side}_regime"), F.col("_cands").alias(f"_{side}_cands"), F.col("_mode").alias(f"_{side}_mode"))), f"{side}_regime", "left")
        )  # both at most MAX_SOURCES rows
    for side in ("paid", "received"):
        said, x, l10, p = F.col(f"{side}_sum"), F.col(f"{side}_x"), F.col(f"_{side}_l"), F.col(f"_{side}_p")
        df = df.withColumn(f"_{side}_log", F.when(x > 0, F.when(said > 0, F.log10(said) + l10).otherwise(F.log10(x) - p + l10)))
    for side, other in (("paid", "received"), ("received", "paid")):
        x = F.col(f"{side}_x")
        miss = F.col(f"{side}_cur").isNull() & F.col(f"_{side}_c").isNull()
        target = F.log10(x) - F.col(f"_{other}_log")
        best = F.array_min(F.transform(F.col(f"_{side}_cands"), lambda c: F.struct(F.abs(target - c["off"]).alias("d"), c["power"].alias("power"), c["code"].alias("code"), c["log_usd"].alias("log_usd"))))
        hit = F.when(miss & (x > 0) & F.col(f"_{other}_log").isNotNull(), best)
        df = df.withColumn(f"_{side}_hit", F.when(hit["d"] <= 0.012, hit))
    for side in ("paid", "received"):
        x, said, hit = F.col(f"{side}_x"), F.col(f"{side}_sum"), F.col(f"_{side}_hit")
        off = F.log10(x / said)
        told = F.when((said > 0) & (x > 0), F.round(off).cast("int")).when(said == x, F.lit(0))
        power = F.coalesce(told, hit["power"], F.col(f"_{side}_p"), F.col(f"_{side}_mode"), F.lit(0))
        lusd = F.coalesce(F.col(f"_{side}_l"), hit["log_usd"])
        value = F.when(said.isNotNull() & (x != 0), said).otherwise(x / F.pow(F.lit(10.0), power))
        df = (
            df.withColumn(f"{side}_power", F.when(x.isNotNull(), power))
            .withColumn(f"{side}_code", F.coalesce(F.col(f"_{side}_c"), hit["code"]))
            .withColumn(f"{side}_usd", F.when(x.isNotNull(), value * F.pow(F.lit(10.0), lusd)))
            .withColumn(f"{side}_odd", F.coalesce(F.when(said.isNotNull() & x.isNotNull(), F.abs(x - said) > 0.005 * F.abs(said)), power != 0))
        )
    return df


def harmonise(trans: DataFrame, feeds: DataFrame, units: DataFrame) -> DataFrame:
    """trans with both sums in whole units and US dollars."""
    stated = statements(trans, feeds)
    return convert(stated, source_graph(stated, feeds, units))


COLUMNS = ("trans_id", "timestamp", "from_bank", "from_account", "to_bank", "to_account", "amount_received", "currency_received", "amount_paid", "currency_paid", "feed_id", "memo")


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, sf_dir, "hi_small_trans", *COLUMNS), table(spark, sf_dir, "trans_feeds"), table(spark, sf_dir, "currency_units")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that do not count whole units of their currency."""
    df = harmonise(*_inputs(spark, sf_dir))
    sides = F.array(*(F.struct(F.lit(s).alias("side"), (F.col(f"{s}_x").isNotNull() & F.col(f"{s}_odd")).alias("odd")) for s in ("paid", "received")))
    return df.select("trans_id", F.explode(sides).alias("s")).where("s.odd").select("trans_id", F.col("s.side").alias("side"))


def p1_amounts_usd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sums of every transaction in US dollars."""
    df = harmonise(*_inputs(spark, sf_dir))
    return df.select("trans_id", "paid_code", F.round("paid_usd", 4).alias("paid_usd"), "received_code", F.round("received_usd", 4).alias("received_usd"))


def p1_source_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources, their snapped conversions and the support each has."""
    trans, feeds, units = _inputs(spark, sf_dir)
    return source_graph(statements(trans, feeds), feeds, units)


#: The rules as plain text matching, for the check on small data.
P1_SQL = r"""
WITH t AS (
  SELECT trans_id, 'paid' AS side, amount_paid AS x, trim(currency_paid) AS c, feed_id, "timestamp" AS ts, CASE WHEN memo IS NULL THEN '' ELSE
    regexp_extract(memo, '(?i)(?:^|;)((?:[^;]*[^;\p{L}])?(?:paid|payer|payé|debit|debited|gezahlt|gezahlter)(?:[^\p{L};][^;]*)?)(?:;|$)', 1) END AS cl FROM hi_small_trans
  UNION ALL
  SELECT trans_id, 'received', amount_received, trim(currency_received), feed_id, "timestamp", CASE WHEN memo IS NULL THEN '' ELSE
    regexp_extract(memo, '(?i)(?:^|;)((?:[^;]*[^;\p{L}])?(?:received|payee|reçu|credit|credited|erhalten|empfangener)(?:[^\p{L};][^;]*)?)(?:;|$)', 1) END FROM hi_small_trans
), u AS (
  SELECT *, trim(regexp_extract(cl, '(?:\b(?:in|en|as)\b|=)\s+([^,;]{1,60}?)\s*(?:,|$)', 1)) AS unit,
    regexp_extract(cl, '(?:^|[ :])(\d(?:[\d., ]*\d)?)(?:[ ,;)]|$)', 1) AS num
  FROM t WHERE x IS NOT NULL
), v AS (
  SELECT *, regexp_replace(num, ' ', '', 'g') AS b FROM u
), w AS (
  SELECT *, CASE WHEN unit <> '' OR b = '' THEN NULL
    WHEN NOT regexp_matches(b, '[.,]') THEN CAST(b AS DOUBLE)
    WHEN (contains(b, '.') AND contains(b, ',')) OR NOT (length(regexp_replace(b, '[^.,]', '', 'g')) > 1 OR (regexp_matches(b, '[.,]\d{3}$') AND NOT regexp_matches(cl, '(?i)kwd|dinar|btc|bitcoin')))
      THEN CAST(regexp_replace(regexp_replace(b, '[.,]\d+$', ''), '[.,]', '', 'g') || '.' || regexp_extract(b, '[.,](\d+)$', 1) AS DOUBLE)
    ELSE CAST(regexp_replace(b, '[.,]', '', 'g') AS DOUBLE) END AS said
  FROM v
), z AS (
  SELECT *, CASE
    WHEN said IS NOT NULL THEN abs(x - said) > 0.005 * abs(said)
    WHEN unit <> '' THEN NOT regexp_matches(unit, '(?i)minor units \((jpy|yen)\)')
    WHEN c IS NOT NULL AND (regexp_matches(c, '(?i)cent|\bct\b|pence|gbx|rappen|\bfen\b|jiao|pais[ae]|kopeck|коп|centavos|fils|satoshi|sats|bits|mbtc|milli|µbtc|thousand|''000|x1000|^teur$|^tchf$|tsd|miles de|тыс|^k[a-z]{3}$| k$|£k|£m| mn$|^mn |million|mio|млн|mdp|lakh|crore|wan |man-yen| 10k')
      OR c IN ('GBp', 'USc', '¢ US')) THEN true
    WHEN feed_id = 7 THEN NOT regexp_matches(coalesce(c, ''), '(?i)yen|jpy|jp¥')
    WHEN feed_id = 8 THEN ts < TIMESTAMP '2024-04-11'
    WHEN feed_id = 9 THEN side = 'paid'
    WHEN feed_id = 10 THEN regexp_matches(coalesce(c, ''), '(?i)btc|xbt|bitcoin|₿')
    WHEN feed_id = 11 THEN side = 'received'
    ELSE false END AS odd
  FROM w
)
SELECT trans_id, side FROM z WHERE odd
"""

ORACLE = {"p1_found": P1_SQL}
QUERIES = {"p1_found": p1_found, "p1_amounts_usd": p1_amounts_usd, "p1_source_graph": p1_source_graph}
