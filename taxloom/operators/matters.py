"""Computations over matters and limbs: statutory figures, deadlines, roll-ups, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money as M
from ..plans.dimensions import GST, Pack
from ..plans.dimensions import penalty_stages as stages_of
from .selection import medians

HEADS = ("igst", "cgst", "sgst", "cess")
# Other names of tiers, the tier of an unknown name, and rupees for a dollar.
TIER_ALIASES, TIERS, SAFE_TIER, RUPEES = {"free": "draft"}, ("draft", "pro"), "draft", 88.0
FLOOR = 10_000


def penalty_stages(matters: DataFrame, pack: Pack = GST) -> DataFrame:
    """A row for each stage of a matter's scheme; matters without a scheme or tax have none."""
    known = matters.withColumn("scheme", M.penalty_scheme(F.col("section"), F.col("fraud"))).where("scheme is not null and tax > 0")
    share = F.col("tax").cast(M.MONEY) * F.col("percent") / 100
    amount = F.when(F.col("floored"), F.greatest(share, F.lit(FLOOR))).otherwise(share).cast(M.MONEY)
    return known.join(F.broadcast(stages_of(matters.sparkSession, pack)), "scheme").select("matter_id", "scheme", "ordinal", "stage", "percent", amount.cast("double").alias("amount"), F.date_add("notice_date", F.col("window")).alias("deadline"))


def computed(matters: DataFrame, as_on: Column) -> DataFrame:
    """Interest, pre-deposit, limitation and amnesty of each matter, null where not computable."""
    ok = M.amnesty_eligible(F.col("section"), F.col("period"))
    return matters.select(
        "matter_id",
        M.interest(F.col("tax"), F.col("notice_date"), as_on, F.col("itc_utilised")).cast("double").alias("interest"),
        M.predeposit(F.col("tax"), F.col("penalty_only")).cast("double").alias("predeposit"),
        M.limitation(F.col("notice_date"), as_on).alias("limitation"),
        F.add_months("notice_date", 3).alias("appeal_by"),
        M.financial_year(F.col("period")).alias("fy"),
        M.amnesty_condition(ok, F.col("tax_paid")).alias("amnesty"),
        M.amount_band(F.col("tax")).alias("band"),
    )


def tax_base(limb_sum: Column, declared: Column) -> Column:
    """What the limbs come to, or, where that is nothing, the declared amount, or 0."""
    return F.coalesce(F.nullif(limb_sum.cast(M.MONEY), F.lit(0).cast(M.MONEY)), declared.cast(M.MONEY), F.lit(0).cast(M.MONEY))


def order_day(order_date: Column, form: Column, notice_date: Column) -> Column:
    """When the order was made: as stated, or the day of a notice that is an order (DRC-07); else null, and no appeal's clock runs."""
    return F.coalesce(order_date, F.when(form == "DRC-07", notice_date))


def appeals(matters: DataFrame, as_on: Column) -> DataFrame:
    """matters: matter_id, limb_sum, declared, order_date, form, notice_date, penalty_only. The tax base, and, only once there is an order, limitation and pre-deposit."""
    known = matters.withColumns({"tax_base": tax_base(F.col("limb_sum"), F.col("declared")), "ordered": order_day(F.col("order_date"), F.col("form"), F.col("notice_date"))})
    deposit = F.when(F.col("ordered").isNotNull(), M.predeposit(F.col("tax_base"), F.col("penalty_only")))
    return known.select("matter_id", "tax_base", "ordered", M.limitation(F.col("ordered"), as_on).alias("limitation"), deposit.alias("predeposit"))


def deadlines(matters: DataFrame, as_on: Column) -> DataFrame:
    """Days to each reply date, its band and words."""
    days = F.date_diff(F.col("due_date"), as_on)
    return matters.select("matter_id", "status", "due_date", days.alias("days"), M.urgency(days).alias("band"), M.deadline_label(days).alias("words"))


def worst_first(matters: DataFrame, as_on: Column, k: int = 10) -> DataFrame:
    """The k open matters to act on first: overdue, critical and urgent ones by days."""
    act = deadlines(matters, as_on).where((F.col("status") != "filed") & F.col("band").isin("overdue", "critical", "urgent")).orderBy("days", "matter_id").limit(k)
    return act.withColumn("rank", F.row_number().over(Window.orderBy("days", "matter_id")))


def deadline_position(matters: DataFrame, as_on: Column) -> DataFrame:
    """Matters by band, filed ones left out."""
    return deadlines(matters, as_on).where("status <> 'filed'").groupBy("band").agg(F.count("*").alias("matters")).withColumn("attention", F.col("band").isin("overdue", "critical", "urgent"))


def deadline_events(matters: DataFrame) -> DataFrame:
    """Calendar rows: the day, its exclusive end, an alarm two days before."""
    return matters.where("due_date is not null").select("matter_id", F.col("due_date").alias("starts"), F.date_add("due_date", 1).alias("ends"), F.date_sub("due_date", 2).alias("alarm"), F.concat_ws(" ", F.lit("Reply due:"), F.col("section")).alias("summary"))


def dashboard(matters: DataFrame) -> DataFrame:
    """Counts and costs by state, by section and in all, in one pass over grouping sets; blanks are left out of their own set."""
    sets = matters.groupingSets([["state"], ["section"], []], "state", "section").agg(F.grouping_id().alias("g"), F.count("*").alias("matters"), F.sum("cost_cents").alias("cost_cents"), F.count_if(F.col("status") == "complete").alias("completed"))
    kind = F.when(F.col("g") == 1, "state").when(F.col("g") == 2, "section").otherwise("all")
    return sets.select(kind.alias("kind"), F.coalesce("state", "section", F.lit("")).alias("name"), "matters", "cost_cents", "completed").where("kind = 'all' or name <> ''")


def roll_up(matters: DataFrame, kinds: list[str], sums: list[str]) -> DataFrame:
    """Counts, sums and completed matters by each of kinds, and in all, in one pass over grouping sets; blanks are left out of their own set."""
    sets = matters.groupingSets([[k] for k in kinds] + [[]], *kinds).agg(F.grouping_id().alias("g"), F.count("*").alias("matters"), *[F.sum(c).alias(c) for c in sums], F.count_if(F.col("status") == "complete").alias("completed"))
    kind = F
    for i, k in enumerate(kinds):  # a bit of the id is 0 for the one column that a set groups by
        kind = kind.when(F.col("g") == (1 << len(kinds)) - 1 - (1 << (len(kinds) - 1 - i)), k)
    return sets.select(kind.otherwise("all").alias("kind"), F.coalesce(*kinds, F.lit("")).alias("name"), "matters", *sums, "completed").where("kind = 'all' or name <> ''")


def head_totals(limbs: DataFrame) -> DataFrame:
    """Rupees by matter and tax head; unread heads aren't zeros and make no row."""
    return limbs.select("matter_id", F.explode("heads").alias("head", "amount")).where("amount is not null").groupBy("matter_id", "head").agg(F.sum("amount").cast("double").alias("amount"))


def plain_heads(heads: Column | None = None, bare: Column | None = None) -> Column:
    """Heads with names in lower case, others than the four and unallocated left out; a bare number is unallocated."""
    if bare is not None:
        return F.when(bare.isNotNull(), F.create_map(F.lit("unallocated"), bare.cast(M.MONEY)))
    named = F.transform_keys(heads, lambda k, _: F.lower(F.trim(k)))
    return F.map_filter(F.transform_values(named, lambda _, x: F.coalesce(x.cast(M.MONEY), F.lit(0).cast(M.MONEY))), lambda k, _: k.isin(*HEADS, "unallocated"))


def add_heads(one: Column, two: Column) -> Column:
    """Heads of both, each head's figures added; zeros are left out."""
    none = F.create_map().cast(f"map<string,{M.MONEY}>")
    zero = F.lit(0).cast(M.MONEY)
    return F.map_filter(F.map_zip_with(F.coalesce(one, none), F.coalesce(two, none), lambda _, x, y: (F.coalesce(x, zero) + F.coalesce(y, zero)).cast(M.MONEY)), lambda _, x: x != 0)


def tier_of(name: Column) -> Column:
    """A tier by its name or another name of it; an unknown one is the tier that anonymises."""
    key = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    real = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in TIER_ALIASES.items() for x in pair]), key), key)
    return F.when(real.isin(*TIERS), real).otherwise(SAFE_TIER)


def run_tier(name: Column) -> Column:
    """tier_of() of a run; one that names none ran on pro."""
    return tier_of(F.coalesce(F.nullif(name, F.lit("")), F.lit("pro")))


def limb_total(heads: Column) -> Column:
    return F.aggregate(F.map_values(heads), F.lit(0).cast("decimal(18,2)"), lambda a, x: (a + F.coalesce(x, F.lit(0))).cast("decimal(18,2)"))


def triage(limbs: DataFrame) -> DataFrame:
    """Argued and settled limbs of each matter, and what they come to."""
    argued, total = M.needs_panel(F.col("posture")), limb_total(F.col("heads"))
    return limbs.withColumn("argued", argued).withColumn("total", total).groupBy("matter_id").agg(
        F.count_if("argued").alias("argued"), F.count_if(~F.col("argued")).alias("settled"),
        F.sum(F.when(F.col("argued"), F.col("total")).otherwise(0)).cast("double").alias("argued_amount"), F.sum("total").cast("double").alias("amount"),
    )


def observed_rates(matters: DataFrame) -> DataFrame:
    """Median cost of an argued limb by tier (two, see run_tier), over complete matters with both; all limbs stand in where none is argued. Exact, by selection."""
    limbs = F.coalesce(F.nullif("argued", F.lit(0)), F.col("limbs"))
    costs = matters.withColumn("n", limbs).where("status = 'complete' and cost_cents > 0 and n > 0").select(run_tier(F.col("tier")).alias("tier"), (F.col("cost_cents") / F.col("n")).alias("rate"))
    return medians(costs, "tier", "rate").withColumnRenamed("median", "rate_cents")


def spend(calls: DataFrame) -> DataFrame:
    """Tokens and cost by run and stage, in rupees too; what is missing counts for nothing."""
    sums = calls.groupBy("run_id", "stage").agg(F.count("*").alias("calls"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("cost_micros"), F.lit(0)).alias("cost_micros"))
    return sums.withColumn("inr", F.round(F.col("cost_micros") / 1_000_000 * RUPEES, 2))
