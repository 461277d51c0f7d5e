"""Feature build for the two-class credit table: one parent, five children, one grandchild.

Each child becomes one row per customer by a single fused aggregate; the wide
parent is a chain of left joins on the customer key, which all feature frames
are already partitioned by.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import (
    age_band, flag, floor_at_zero, pick, ratio, row_kurtosis, row_mean, row_missing, row_sum, strict_sum,
)
from ..operators.aggregate import (
    Slice, add_differences, add_ratios, aggregate, group_statistics, merge_specs, quoted, shares, together,
)
from ..operators.clean import columns_like, sentinels_to_null
from ..operators.combine import attach, with_borrowed_columns
from ..operators.ordered import first_value, last_value
from ..operators.partial import aggregate_by_part, merge_met, met_states
from ..operators.profile import Profiled, two_value_columns
from . import fixed as X

CUSTOMER, LOAN, BUREAU_LOAN, LABEL = "SK_ID_CURR", "SK_ID_PREV", "SK_ID_BUREAU", "TARGET"
DAYS_PER_MONTH = 30


def feature_slice(*args, **kwargs) -> Slice:
    return Slice(*args, **kwargs, doubles=True)


def _share_spec(df: DataFrame, columns: Sequence[str] | None) -> dict[str, list[str]]:
    """Means of 0/1 columns: the given ones, or those a profiling pass finds."""
    return shares(two_value_columns(df) if columns is None else columns)


# --- parent --------------------------------------------------------------------


def application_columns(df: DataFrame, missing_over: Sequence[str] | None = None) -> DataFrame:
    """Ratios, differences and row-wise statistics of the parent table.

    ``missing_over`` lists the columns whose gaps are counted (default: the columns of ``df``).
    """
    docs = columns_like(df, contains="FLAG_DOC")
    live = columns_like(df, starts="FLAG_", without=("FLAG_DOC", "_FLAG_"))
    missing = row_missing(missing_over or df.columns)
    years = F.col("DAYS_BIRTH") * F.lit(-1.0 / 365)
    payments = ratio("AMT_CREDIT", "AMT_ANNUITY")
    df = add_differences(add_ratios(df, X.APPLICATION_RATIOS), X.APPLICATION_DIFFERENCES)
    return df.withColumns(
        {
            "NEW_EXT_SOURCES_MEAN": row_mean(X.EXT_SOURCES),
            "document_sum": strict_sum(X.DOCUMENT_FLAGS),
            "ANN_LENGTH_EMPLOYED_RATIO": ratio(payments, "DAYS_EMPLOYED"),
            "age_finish": years + payments * F.lit(1.0 / 12),
            "ANN_LENGTH_AGE_RATIO": ratio(payments * F.lit(1.0 / 12), "DAYS_BIRTH") * F.lit(-1.0 / 365),
            "NEW_DOC_IND_KURT": row_kurtosis(docs),
            "NEW_LIVE_IND_SUM": row_sum(live),
            "AGE_RANGE": age_band("DAYS_BIRTH"),
            "AMT_MISSING_FIELDS": missing,
        }
    )


def application_features(
    df: DataFrame, raw: DataFrame | None = None, missing_over: Sequence[str] | None = None
) -> DataFrame:
    """Parent columns plus group statistics; group texts come from ``raw`` where ``df`` lost them."""
    borrowed = [c for c in X.GROUP_TEXTS if c not in df.columns]
    if borrowed:
        if raw is None:
            raise ValueError(f"group columns {borrowed} are missing: pass the raw table")
        df = with_borrowed_columns(df, raw, CUSTOMER, X.GROUP_TEXTS)
    out = group_statistics(application_columns(df, missing_over), X.GROUP_KEYS, X.GROUP_STATISTICS)
    return out.drop(*X.GROUP_TEXTS) if borrowed else out


# --- bureau --------------------------------------------------------------------


def balance_per_loan(balance: DataFrame, share_columns: Sequence[str] | None = None) -> DataFrame:
    """One row per bureau loan: month range, month count and status shares."""
    spec = merge_specs(X.BALANCE_SPEC, _share_spec(balance, share_columns))
    return aggregate(balance, BUREAU_LOAN, [feature_slice(spec)])


def bureau_rows(
    bureau: DataFrame, balance: DataFrame, balance_shares: Sequence[str] | None = None, fanout: bool = False
) -> DataFrame:
    """Bureau rows with their balance summary.

    By default a loan stays one row and its status columns are shares over its
    months.  ``fanout=True`` repeats the loan once per month instead, which weights
    every later mean, sum and count by months.
    """
    statuses = [c for c in balance.columns if c.startswith("STATUS_")]
    per_loan = balance_per_loan(balance, statuses if balance_shares is None else balance_shares)
    if fanout:
        df = bureau.join(per_loan, BUREAU_LOAN, "left").join(balance, BUREAU_LOAN, "left")
    else:
        df = bureau.join(per_loan, BUREAU_LOAN, "left").withColumnsRenamed({f"{c}_MEAN": c for c in statuses})
    return df.drop(BUREAU_LOAN)


def bureau_columns(rows: DataFrame) -> DataFrame:
    """Derived columns of the rows of :func:`bureau_rows`."""
    df = rows.withColumn("STATUS_12345", strict_sum(X.STATUS_SUM))
    return add_differences(add_ratios(df, X.BUREAU_RATIOS), X.BUREAU_DIFFERENCES)


def bureau_slices(share_columns: Sequence[str], months: Sequence[int] = (6, 12)) -> list[Slice]:
    out = [
        feature_slice(merge_specs(X.BUREAU_SPEC, shares(share_columns), shares(["STATUS_C"])), "BURO_"),
        feature_slice(X.BUREAU_ACTIVE_SPEC, "BURO_ACTIVE_", "CREDIT_ACTIVE_Active = 1"),
        feature_slice(X.BUREAU_CLOSED_SPEC, "BURO_CLOSED_", "CREDIT_ACTIVE_Closed = 1"),
    ]
    for kind, prefix in X.LOAN_TYPES.items():
        out.append(feature_slice(X.BUREAU_TYPE_SPEC, prefix, f"`CREDIT_TYPE_{kind}` = 1"))
    for m in months:
        out.append(feature_slice(X.BUREAU_RECENT_SPEC, f"BURO_LAST{m}M_", f"DAYS_CREDIT >= {-DAYS_PER_MONTH * m}"))
    return out


def bureau_features(
    bureau: DataFrame,
    balance: DataFrame,
    share_columns: Sequence[str] | None = None,
    balance_shares: Sequence[str] | None = None,
    fanout: bool = False,
) -> DataFrame:
    """One row per customer from bureau loans, all slices in one aggregate.

    The last value is taken from the loans alone: repeating a loan or adding to its columns does not change it.
    """
    rows = bureau_rows(bureau, balance, balance_shares, fanout)
    slices = bureau_slices(list(_share_spec(bureau_columns(rows), share_columns)))
    base = aggregate(bureau_columns(together(rows, CUSTOMER)), CUSTOMER, slices, met=True)
    recent = bureau.where(F.col(CUSTOMER).isNotNull()).groupBy(CUSTOMER).agg(
        last_value("AMT_CREDIT_MAX_OVERDUE", ["DAYS_CREDIT"]).alias("BURO_LAST_LOAN_MAX_OVERDUE")
    )
    return add_ratios(base.join(recent, CUSTOMER, "left"), X.BUREAU_TOTAL_RATIOS)


# --- previous applications -------------------------------------------------------


def previous_columns(prev: DataFrame) -> DataFrame:
    df = sentinels_to_null(prev, X.PREVIOUS_DAY_COLUMNS, X.UNKNOWN_DAY)
    df = add_differences(add_ratios(df, X.PREVIOUS_RATIOS), X.PREVIOUS_DIFFERENCES)
    paid = F.col("AMT_ANNUITY") * F.col("CNT_PAYMENT")
    return df.withColumn("SIMPLE_INTERESTS", ratio(ratio(paid, "AMT_CREDIT") - 1, "CNT_PAYMENT"))


def previous_slices(share_columns: Sequence[str], months: Sequence[int] = (6, 12)) -> list[Slice]:
    out = [
        feature_slice(merge_specs(X.PREVIOUS_SPEC, shares(share_columns)), "PREV_"),
        feature_slice(X.PREVIOUS_SPEC, "APPROVED_", "NAME_CONTRACT_STATUS_Approved = 1"),
        feature_slice(X.PREVIOUS_SPEC, "REFUSED_", "NAME_CONTRACT_STATUS_Refused = 1"),
    ]
    for m in months:
        out.append(feature_slice(X.PREVIOUS_RECENT_SPEC, f"PREV_LAST{m}M_", f"DAYS_DECISION >= {-DAYS_PER_MONTH * m}"))
    return out


def previous_features(prev: DataFrame, share_columns: Sequence[str] | None = None) -> DataFrame:
    slices = previous_slices(list(_share_spec(previous_columns(prev), share_columns)))
    return aggregate(previous_columns(together(prev, CUSTOMER)), CUSTOMER, slices, met=True)


# --- instalments -----------------------------------------------------------------


def instalment_columns(inst: DataFrame, late_from: str = "DBD") -> DataFrame:
    """Days past and before due, payment shares and late flags.

    ``late_from="DBD"`` flags early payment as the workload does; ``"DPD"`` flags late payment.
    """
    delay = F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")
    df = inst.withColumns(
        {
            "DPD": floor_at_zero(delay),
            "DBD": floor_at_zero(-delay),
            "PAYMENT_PERC": ratio("AMT_PAYMENT", "AMT_INSTALMENT"),
            "PAYMENT_DIFF": F.col("AMT_INSTALMENT") - F.col("AMT_PAYMENT"),
        }
    )
    late = F.col(late_from) > 0
    share = pick(late, "PAYMENT_PERC")
    return df.withColumns(
        {
            "LATE_PAYMENT": flag(late),
            "LATE_PAYMENT_RATIO": share,
            "SIGNIFICANT_LATE_PAYMENT": flag(share > 0.05),
            "DPD_7": flag(F.col("DPD") >= 7),
            "DPD_15": flag(F.col("DPD") >= 15),
        }
    )


def instalment_slices(share_columns: Sequence[str], months: Sequence[int] = (36, 60)) -> list[Slice]:
    out = [feature_slice(merge_specs(X.INSTALMENT_SPEC, shares(share_columns)), "INSTAL_")]
    for m in months:
        out.append(feature_slice(X.INSTALMENT_RECENT_SPEC, f"INS_{m}M_", f"__seen >= {-DAYS_PER_MONTH * m}"))
    return out


def latest_of_part(part: str, when: str) -> str:
    """SQL of the latest ``when`` of a part; rows without a part are never recent."""
    return f"max({quoted(when)}) FILTER (WHERE {quoted(part)} IS NOT NULL)"


def instalment_features(
    inst: DataFrame, share_columns: Sequence[str] | None = None, late_from: str = "DBD"
) -> DataFrame:
    slices = instalment_slices(list(_share_spec(instalment_columns(inst, late_from), share_columns)))
    df = instalment_columns(together(inst, CUSTOMER), late_from)
    out = aggregate_by_part(df, CUSTOMER, LOAN, slices, {"__seen": latest_of_part(LOAN, "DAYS_INSTALMENT")}, met=True)
    return out.withColumns(
        {
            "INSTAL_TOTAL_PAYMENT_RATE": ratio("INSTAL_AMT_PAYMENT_SUM", "INSTAL_AMT_INSTALMENT_SUM"),
            "INSTAL_COUNT": F.col("INSTAL_SK_ID_PREV_SIZE"),
        }
    )


# --- monthly cash balances ---------------------------------------------------------


def cash_columns(cash: DataFrame) -> DataFrame:
    return add_ratios(cash, X.CASH_RATIOS).withColumns(
        {
            "INSTALMENT_BALANCE_RATIO": ratio("CNT_INSTALMENT_FUTURE", F.abs("MONTHS_BALANCE")),
            "LATE_PAYMENT": flag(F.col("SK_DPD") > 0),
        }
    )


def cash_per_loan(df: DataFrame) -> DataFrame:
    """One row per loan: ends of its history, completion and late months."""
    month = ["MONTHS_BALANCE"]
    done = F.avg("NAME_CONTRACT_STATUS_Completed")
    first, last = first_value("CNT_INSTALMENT", month), last_value("CNT_INSTALMENT", month)
    left = last_value("CNT_INSTALMENT_FUTURE", month)
    return df.where(F.col(LOAN).isNotNull()).groupBy(LOAN).agg(
        first_value(CUSTOMER, month).alias(CUSTOMER),
        F.max("MONTHS_BALANCE").alias("MONTHS_BALANCE_MAX"),
        done.alias("POS_LOAN_COMPLETED_MEAN"),
        flag((first - last > 0) & (done > 0)).alias("POS_COMPLETED_BEFORE_MEAN"),
        ratio(left, last).alias("POS_REMAINING_INSTALMENTS_RATIO"),
        F.sum("LATE_PAYMENT").alias("LATE_PAYMENT_SUM"),
        first.alias("__first"),
        last.alias("__last"),
        left.alias("__left"),
    )


def _split_ordered(spec: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    kept = {c: [f for f in funcs if f not in ("first", "last")] for c, funcs in spec.items()}
    return {c: funcs for c, funcs in kept.items() if funcs}


def _end(func: str, column: str, by: Sequence[str], among: str = "true") -> str:
    """SQL of the first or last non-missing value of a window over ``by[:-1]`` in the order of ``by[-1]`` (ties: the smallest or largest)."""
    keys, order = ", ".join(by[:-1]), by[-1]
    rows = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    return f"{func}_value(CASE WHEN {among} THEN {column} END) IGNORE NULLS OVER (PARTITION BY {keys} ORDER BY {order}, {column} {rows})"


def cash_features(
    cash: DataFrame, share_columns: Sequence[str] | None = None, recent_loans: int = 3, recent_by: str = LOAN
) -> DataFrame:
    """One row per customer from monthly cash balances, which are read once.

    First and last values run over (loan, month), so they are read off the states of the loans,
    which are far fewer than the monthly rows.  A loan belongs to one customer.
    """
    spec = merge_specs(X.CASH_SPEC, _share_spec(cash_columns(cash), share_columns))
    slices = [feature_slice(_split_ordered(spec), "POS_")]
    month = [CUSTOMER, LOAN, "MONTHS_BALANCE"]
    ends = {"__first": ("first", "CNT_INSTALMENT"), "__last": ("last", "CNT_INSTALMENT"), "__left": ("last", "CNT_INSTALMENT_FUTURE")}
    df = cash_columns(together(cash, CUSTOMER)).withColumns({n: F.expr(_end(f, c, month)) for n, (f, c) in ends.items()})
    loan = {
        "__loan": f"count({LOAN})", "__done": "avg(NAME_CONTRACT_STATUS_Completed)", "LATE_PAYMENT_SUM": "sum(LATE_PAYMENT)",
        "MONTHS_BALANCE_MAX": "max(MONTHS_BALANCE)", **{n: f"max({n})" for n in ends},
    }
    loans = met_states(df, CUSTOMER, LOAN, slices, loan)  # rows without a loan are no loan, but count for the slices
    done = F.col("__done")
    loans = loans.withColumns({
        "POS_LOAN_COMPLETED_MEAN": done,
        "POS_COMPLETED_BEFORE_MEAN": flag((F.col("__first") - F.col("__last") > 0) & (done > 0)),
        "POS_REMAINING_INSTALMENTS_RATIO": ratio("__left", "__last"),
    })
    loans = loans.withColumns({
        "__newest": F.expr(f"row_number() OVER (PARTITION BY {CUSTOMER} ORDER BY __loan > 0 DESC, {quoted(recent_by)} DESC NULLS LAST)"),
        **{f"{n}_of_all": F.expr(_end(f, n, [CUSTOMER, LOAN], "__loan > 0")) for n, f in (("__first", "first"), ("__last", "last"), ("__left", "last"))},
    })
    only = "FILTER (WHERE __loan > 0)"
    more = {
        "POS_CNT_INSTALMENT_FIRST": "max(__first_of_all)", "POS_CNT_INSTALMENT_LAST": "max(__last_of_all)",
        "POS_CNT_INSTALMENT_FUTURE_LAST": "max(__left_of_all)",
        **{
            c: f"if(count(1) {only} > 0, coalesce(sum({c}) {only}, 0), NULL)"
            for c in ("POS_LOAN_COMPLETED_MEAN", "POS_COMPLETED_BEFORE_MEAN", "POS_REMAINING_INSTALMENTS_RATIO")
        },
        "LATE_PAYMENT_SUM": f"avg(LATE_PAYMENT_SUM) FILTER (WHERE __loan > 0 AND __newest <= {recent_loans})",
    }
    return merge_met(loans, CUSTOMER, LOAN, slices, more).withColumn("POS_COUNT", F.col("POS_MONTHS_BALANCE_SIZE"))


# --- monthly card balances -----------------------------------------------------------


def relative_name(column: str) -> str:
    return column.replace("CNT_", "RELATIVE_", 1)


def card_columns(card: DataFrame) -> DataFrame:
    df = add_differences(add_ratios(card, X.CARD_RATIOS), X.CARD_DIFFERENCES)
    extra = {relative_name(c): ratio(c, "CNT_DRAWINGS_CURRENT") for c in X.CARD_DRAWINGS}
    extra["INSTALMENT_MATURE_BALANCE_RATIO"] = ratio("CNT_INSTALMENT_MATURE_CUM", F.abs("MONTHS_BALANCE"))
    extra["LATE_PAYMENT"] = flag(F.col("SK_DPD") > 0)
    return df.withColumns(extra)


def card_slices(
    share_columns: Sequence[str], months: Sequence[int] = (12, 24, 48), prefix: str = "INS_",
    month_factor: int = DAYS_PER_MONTH,
) -> list[Slice]:
    relative = {relative_name(c): X.CARD_RELATIVE_FUNCTIONS for c in X.CARD_DRAWINGS}
    sizes = {"MONTHS_BALANCE": ["size"]}
    out = [
        feature_slice(
            merge_specs(X.CARD_SPEC, relative, shares(share_columns), sizes),
            "CC_",
            names={("MONTHS_BALANCE", "size"): "CC_COUNT"},
        )
    ]
    for m in months:
        out.append(feature_slice(X.CARD_RECENT_SPEC, f"{prefix}{m}M_", f"__seen >= {-month_factor * m}"))
    return out


def card_features(
    card: DataFrame,
    share_columns: Sequence[str] | None = None,
    window_prefix: str = "INS_",
    month_factor: int = DAYS_PER_MONTH,
    ties: Sequence[str] = (),
) -> DataFrame:
    """One row per customer from monthly card balances.

    ``ties`` orders months that occur twice within a loan.  ``month_factor=1`` makes
    the windows months; the default keeps the workload's factor of 30.
    """
    slices = card_slices(list(_share_spec(card_columns(card), share_columns)), prefix=window_prefix, month_factor=month_factor)
    df = card_columns(together(card, CUSTOMER))
    newest = ", ".join(["MONTHS_BALANCE DESC NULLS LAST", *[f"{quoted(t)} ASC NULLS LAST" for t in ties]])
    df = df.withColumn("__newest", F.expr(f"row_number() OVER (PARTITION BY {CUSTOMER}, {LOAN} ORDER BY {newest}) = 1"))
    extra = {"__seen": latest_of_part(LOAN, "MONTHS_BALANCE"), "__loan": f"count({LOAN})"}
    last = {f"__last_{c}": f"max({quoted(c)}) FILTER (WHERE __newest)" for c in X.CARD_LAST_SPEC}
    parts = met_states(df, CUSTOMER, LOAN, slices, extra | last)
    ends = feature_slice(X.CARD_LAST_SPEC, "CC_LAST_")
    # fixed values: functions of the last rows -> SQL aggregates
    sql = {"mean": "avg", "max": "max"}
    more = {
        ends.name(c, f): f"{sql[f]}({quoted(f'__last_{c}')}) FILTER (WHERE __loan > 0)" for c, funcs in ends.spec.items() for f in funcs
    }
    return merge_met(parts, CUSTOMER, LOAN, slices, more)


# --- whole build -------------------------------------------------------------------


def cross_table_ratios(df: DataFrame, missing: Sequence[str] = ()) -> DataFrame:
    """Ratios between child aggregates and parent columns; NULL for those over a column that is ``missing``."""
    known = {n: p for n, p in X.CROSS_TABLE_RATIOS.items() if not set(p) & set(missing)}
    none = {n: F.lit(None).cast("double") for n in X.CROSS_TABLE_RATIOS if n not in known}
    return add_ratios(df, known).withColumns(none).select(*df.columns, *X.CROSS_TABLE_RATIOS)


def child_features(
    tables: Mapping[str, DataFrame], shares_of: Mapping[str, Sequence[str]] | None = None,
    card_ties: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """The five customer-level feature frames; ``shares_of`` names 0/1 columns per table."""
    given = shares_of or {}
    return {
        "bureau": bureau_features(
            tables["bureau"], tables["bureau_balance"], given.get("bureau"), given.get("bureau_balance")
        ),
        "cash": cash_features(tables["cash"], given.get("cash")),
        "credit": card_features(tables["credit"], given.get("credit"), ties=card_ties),
        "installments": instalment_features(tables["installments"], given.get("installments")),
        "previous": previous_features(tables["previous"], given.get("previous")),
    }


def build_features(
    train: DataFrame,
    test: DataFrame,
    tables: Mapping[str, DataFrame],
    raw: DataFrame | None = None,
    shares_of: Mapping[str, Sequence[str]] | None = None,
    drop_useless: bool = True,
    card_ties: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Wide train and test frames: parent columns, all children, cross-table ratios.

    Group statistics are worked out within each split.  Useless columns of the train rows are found without the
    wide frame: each child's features are stored once, for the customers of both splits, and so is the
    train parent; the states of their columns are added up, and customers without a child count as missing in
    its columns.  The joins then read the kept columns alone.  A cross-table ratio with a column
    that was dropped is NULL.
    """
    parts = child_features(tables, shares_of, card_ties)
    parents = [application_features(df, raw) for df in (train, test)]
    if not drop_useless:
        return tuple(cross_table_ratios(attach(parent, list(parts.values()), CUSTOMER)) for parent in parents)
    ids = train.select(CUSTOMER, F.lit(True).alias("__train")).union(test.select(CUSTOMER, F.lit(False)))
    own = Profiled(parents[0], "parent", skip=(CUSTOMER, LABEL))
    parents[0] = own.frame
    gone, kept = own.useless(own.rows), []
    for name, part in parts.items():
        held = Profiled(part.join(ids, CUSTOMER), f"features-{name}", F.col("__train"), skip=(CUSTOMER, "__train"))
        dropped = held.useless(own.rows)
        gone += dropped
        kept.append(held.frame.drop("__train", *dropped))
    parents = [parent.drop(*gone) for parent in parents]
    return tuple(cross_table_ratios(attach(parent, kept, CUSTOMER), missing=gone) for parent in parents)
