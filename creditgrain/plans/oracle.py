"""SQL for the named queries, in DuckDB's dialect, over the same tables.

Every ``round`` has the nudge that the queries use to settle exact ties.
"""

from __future__ import annotations

from ..operators.features import ATTRIBUTES, FEATURES, RFM_SUMMARY
from ..schema import TRANSACTIONS

# Fixed values, written out here so that a wrong one in the library does not agree with itself:
# smallest probability distinguished from 0; lowest score, amount, duration and tier of each
# band, and what is below; the missing category, the smoothing term, the distinct values
# below which an integer is a category; points of a density.
EDGE = 1e-9
LOAN_BANDS = (
    (750, 50000.0, "6 months", "Lowest"),
    (650, 20000.0, "3 months", "Low"),
    (550, 5000.0, "1 month", "Moderate"),
    (450, 1000.0, "2 weeks", "High"),
)
DECLINED = (0.0, "Declined", "N/A")
MISSING = "__MISSING__"
SMOOTHING = 0.001
FEW_VALUES = 50
KDE_POINTS = 200

LINES = """
select l_orderkey*10+l_linenumber as TransactionId, l_orderkey as BatchId, o_custkey as AccountId,
  o_custkey as SubscriptionId, o_custkey as CustomerId, r_name as CurrencyCode, s_nationkey as CountryCode,
  l_suppkey as ProviderId, l_partkey as ProductId, p_type as ProductCategory, o_orderpriority as ChannelId,
  case when l_returnflag='R' then -l_extendedprice else l_extendedprice end as Amount,
  l_extendedprice as Value, o_orderdate as TransactionStartTime,
  cast(round(l_discount*100) as int)%5 as PricingStrategy,
  case when l_returnflag='R' and l_linestatus='F' and l_quantity>=48 then 1 else 0 end as FraudResult
from lineitem join orders on l_orderkey=o_orderkey join part on l_partkey=p_partkey
  join supplier on l_suppkey=s_suppkey join nation on s_nationkey=n_nationkey
  join region on n_regionkey=r_regionkey"""

EVENTS = """
select event_id as TransactionId, cast(floor(event_id/200) as bigint) as BatchId, user_id as AccountId,
  user_id as SubscriptionId, user_id as CustomerId,
  case k%4 when 0 then 'KES' when 1 then 'USD' when 2 then 'UGX' end as CurrencyCode,
  cast(250+k%6 as int) as CountryCode, cast(k%9 as bigint) as ProviderId, cast(1000+k%20 as bigint) as ProductId,
  event_type as ProductCategory,
  case when k%3=0 then 'Web' when k%3=1 then 'Android' else 'IOS' end as ChannelId,
  case when event_type='error' then -value else value end as Amount, value as Value,
  ts as TransactionStartTime, cast(k%5 as int) as PricingStrategy,
  case when event_type='error' and value>150 then 1 else 0 end as FraudResult
from (select *, cast(json_extract_string(props,'$.k') as int) as k from events)"""

COLUMNS = TRANSACTIONS.names
NUMERIC = [f.name for f in TRANSACTIONS if f.dataType.simpleString() in ("bigint", "int", "double")]
TEXT = [f.name for f in TRANSACTIONS if f.dataType.simpleString() == "string"]
PLOTTED = ["CountryCode", "Amount", "Value", "PricingStrategy"]
MODES = ("MostFrequentChannel", "MostFrequentProductCategory", "MostFrequentCurrencyCode")
# the account features that are numbers and go into a model
MODEL_NUMERIC = [
    c for c in FEATURES if c not in (*MODES, "HasFraud", "TotalFraudTransactions")
]

DOUBLES = {
    "Monetary", "AvgAmount", "MaxValue", "MinAmount", "StdAmount", "AvgTransactionHour",
    "AvgTransactionDayOfMonth", "AvgTransactionDayOfWeek", "AvgTransactionMonth", "AvgTransactionYear",
}


def with_(parts: dict[str, str], final: str) -> str:
    return "with " + ",\n".join(f"{n} as materialized ({q})" for n, q in parts.items()) + "\n" + final


def feature_parts(txns: str, now: str | None = None, amount: str = "Value", prefix: str = "") -> dict[str, str]:
    """Table expressions ending in ``f``, the unrounded account features; their names begin with ``prefix``."""
    t, now = f"{prefix}t", now or f"(select max(TransactionStartTime) from {prefix}t)"
    parts = {t: txns}
    parts[f"{prefix}m"] = f"""
select AccountId, max(TransactionStartTime) as last_time,
  cast(floor(date_diff('microsecond', max(TransactionStartTime), {now}) / 86400000000) as bigint) as Recency,
  count(TransactionId) as Frequency, coalesce(sum(Value),0) as Monetary,
  cast(coalesce(sum(FraudResult),0) > 0 as int) as HasFraud, avg({amount}) as AvgAmount,
  max(Value) as MaxValue, min(Value) as MinAmount, coalesce(stddev_samp(Value),0) as StdAmount,
  cast(coalesce(sum(FraudResult),0) as bigint) as TotalFraudTransactions,
  count(distinct ProductCategory) as UniqueProductCategories, count(distinct ChannelId) as UniqueChannels,
  count(distinct ProviderId) as UniqueProviders, count(distinct CurrencyCode) as UniqueCurrencies,
  count(distinct CountryCode) as UniqueCountries,
  avg(hour(TransactionStartTime)) as AvgTransactionHour, avg(day(TransactionStartTime)) as AvgTransactionDayOfMonth,
  avg(isodow(TransactionStartTime)-1) as AvgTransactionDayOfWeek, avg(month(TransactionStartTime)) as AvgTransactionMonth,
  avg(year(TransactionStartTime)) as AvgTransactionYear,
  cast(min(hour(TransactionStartTime)) as int) as MinTransactionHour,
  cast(max(hour(TransactionStartTime)) as int) as MaxTransactionHour
from {t} where AccountId is not null group by AccountId"""
    joins = ""
    for column, _, mode in ATTRIBUTES:
        parts[f"{prefix}mode_{column}"] = f"""
select AccountId, {column} as {mode} from (
  select AccountId, {column}, row_number() over (partition by AccountId order by count(*) desc, {column}) as place
  from {t} where {column} is not null group by AccountId, {column}) where place = 1"""
        joins += f" left join {prefix}mode_{column} using (AccountId)"
    parts[f"{prefix}f"] = f"select AccountId, {', '.join(FEATURES)} from {prefix}m{joins}"
    return parts


def show(columns, digits: int = 4) -> str:
    return ", ".join(f"round(3e-{digits + 3}+{c},{digits}) as {c}" if c in DOUBLES else c for c in columns)


def features_sql(txns: str, columns=FEATURES, **options) -> str:
    return with_(feature_parts(txns, **options), f"select AccountId, {show(columns)} from f")


def melted(table: str, columns, keep: str = "", dtype: str = "double") -> str:
    return " union all ".join(
        f"select {keep}'{c}' as \"column\", {i} as column_id, cast({c} as {dtype}) as value from {table}"
        for i, c in enumerate(columns)
    )


def quartiles(group: str = '"column"') -> str:
    return f"""
select {group}, count(value) as n, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median,
  quantile_cont(value, 0.75) as q3 from v where value is not null group by {group}"""


def correlations(parts: dict[str, str], table: str, columns, label: str | None = None) -> str:
    def pair(a: str, b: str) -> str:
        return f"""
select '{a}' as "left", '{b}' as "right", case when stddev_pop(x) = 0 or stddev_pop(y) = 0 then null
  else round(3e-9+covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 6) end as correlation
from (select cast({a} as double) as x, cast({b} as double) as y from {table}) where x is not null and y is not null"""

    if label is None:
        return with_(parts, " union all ".join(pair(a, b) for a in columns for b in columns))
    pairs = " union all ".join(pair(a, label) for a in columns)
    return with_(parts, f'select "left" as "column", correlation from ({pairs})')


def box_sql(parts: dict[str, str], values: str, by: str = "") -> str:
    keys = f'{by}, "column"' if by else '"column"'
    final = f"""
select {keys}, n, round(3e-7+q1,4) as q1, round(3e-7+median,4) as median, round(3e-7+q3,4) as q3,
  round(3e-7+least(min(case when value between q1-1.5*(q3-q1) and q3+1.5*(q3-q1) then value end), q1),4) as whisker_low,
  round(3e-7+greatest(max(case when value between q1-1.5*(q3-q1) and q3+1.5*(q3-q1) then value end), q3),4) as whisker_high,
  count(*) filter (where value < q1-1.5*(q3-q1) or value > q3+1.5*(q3-q1)) as outliers
from v join q using ({keys}) where value is not null group by {keys}, n, q1, median, q3"""
    return with_({**parts, "v": values, "q": quartiles(keys)}, final)


def hash_sql(key: str, seed: int = 42) -> str:
    return f"cast('0x'||substr(md5({key}||':{seed}'),1,15) as bigint)"


SPLIT_PARTS = {
    "sizes": "select HasFraud, count(*) as c from f group by HasFraud",
    "train_total": "select sum(c) as n, sum(c) - ceil(sum(c) * 0.2) as train from sizes",
    "shares": """
select HasFraud, c, floor(train * c / n) as share,
  row_number() over (order by floor(train * c / n) - train * c / n, HasFraud) as place,
  train - sum(floor(train * c / n)) over () as left_over from sizes, train_total""",
    "quota": "select HasFraud, c - share - case when place <= left_over then 1 else 0 end as test_rows from shares",
    "s": f"""
select f.*, case when row_number() over (partition by HasFraud order by {hash_sql('AccountId')}, AccountId) <= test_rows
  then 'test' else 'train' end as split from f join quota using (HasFraud)""",
}


def split_parts() -> dict[str, str]:
    return {**feature_parts(LINES), **SPLIT_PARTS}


def numeric_stats_parts(source: str, columns) -> dict[str, str]:
    return {
        "v": melted(source, columns),
        "med": 'select "column", median(value) as med from v group by "column"',
        "stats": """select "column", med, avg(coalesce(value, med)) as mean,
  case when stddev_pop(coalesce(value, med)) = 0 then 1 else stddev_pop(coalesce(value, med)) end as std
  from v join med using ("column") group by "column", med""",
    }


def scaled_exactly(column: str) -> str:
    one = "(select {} from stats where \"column\" = '" + column + "')"
    return f"(coalesce({column}, {one.format('med')}) - {one.format('mean')}) / {one.format('std')}"


def scaled(column: str) -> str:
    return f"round(3e-7+{scaled_exactly(column)}, 4)"


def woe_parts(source: str, columns=MODES) -> dict[str, str]:
    values = " union all ".join(
        f"select '{c}' as feature, coalesce(cast({c} as varchar), '{MISSING}') as category, HasFraud from {source}"
        for c in columns
    )
    s = SMOOTHING
    return {
        "cats": values,
        "woe": f"""
select feature, category, count(*) as n, cast(sum(HasFraud) as bigint) as bad,
  ln(((count(*) - sum(HasFraud) + {s}) / ((select count(*) - sum(HasFraud) from {source}) + 2*{s}))
   / ((sum(HasFraud) + {s}) / ((select sum(HasFraud) from {source}) + 2*{s}))) as woe
from cats group by feature, category""",
    }


def weight_exactly(column: str) -> str:
    category = f"coalesce(cast(x.{column} as varchar), '{MISSING}')"
    return f"coalesce((select woe from woe where feature = '{column}' and category = {category}), 0)"


def weight(column: str, digits: int = 6) -> str:
    return f"round(3e-{digits + 3}+{weight_exactly(column)}, {digits})"


SCORE = f"""case when p < 1 then cast(round_even(600 - 20 * ln(
  case when p = 0 then {EDGE} / (1 - {EDGE}) else p / (1 - p) end), 0) as int) end"""


def terms(position: int) -> str:
    def text(v):
        return f"cast({v} as double)" if isinstance(v, float) else f"'{v}'"

    whens = " ".join(f"when credit_score >= {b[0]} then {text(b[position])}" for b in LOAN_BANDS)
    return f"case when credit_score is null then null {whens} else {text(DECLINED[position - 1])} end"


NEWTON_STEPS = 10
#: The inputs of a row of account features ``x`` as a list, with a 1 for the intercept.
MODEL_INPUTS = (
    "[" + ", ".join(f"cast({v} as double)" for v in [*map(scaled_exactly, MODEL_NUMERIC), *map(weight_exactly, MODES), "1.0"]) + "]"
)


def logit_parts() -> dict[str, str]:
    """Table expressions from ``f`` to ``beta``, the coefficients of the penalised logistic
    regression on the oversampled training rows, by Newton's method.

    ``inputs`` has the model inputs of all accounts with a 1 for the intercept. In each step
    the Hessian's rows, each with its gradient, are eliminated one after the other in a
    recursive query; the last number of each row is then the step.
    """
    d = len(MODEL_NUMERIC) + len(MODES)
    parts = {
        **split_parts(),
        "train": "select * from s where split = 'train'",
        **numeric_stats_parts("train", MODEL_NUMERIC),
        **woe_parts("train"),
        "inputs": f"select AccountId, HasFraud, split, {MODEL_INPUTS} as v from s x",
        "fit_rows": "select AccountId, HasFraud, v from inputs where split = 'train'",
        "fit_sizes": "select HasFraud, count(*) as c from fit_rows group by HasFraud",
        "fit_pool": f"""select v, HasFraud, row_number() over (order by {hash_sql('AccountId')}, AccountId) - 1 as row_
  from fit_rows where HasFraud = (select HasFraud from fit_sizes order by c, HasFraud limit 1)""",
        "fit_draws": f"""select {hash_sql('i')} % (select min(c) from fit_sizes) as row_
  from (select unnest(range((select max(c) - min(c) from fit_sizes))) as i)""",
        "fit": "select v, HasFraud as y from fit_rows union all select v, HasFraud from fit_draws join fit_pool using (row_)",
        "beta0": f"select list_transform(range({d + 1}), lambda i: cast(0 as double)) as b",
    }
    for k in range(NEWTON_STEPS):
        parts[f"fitted{k}"] = f"select v, y, 1 / (1 + exp(-list_dot_product(v, b))) as p from fit, beta{k}"
        parts[f"hessian{k}"] = f"""
select i, list(v + case when i = j and i <= {d} then 1 else 0 end order by j) as h from (
  select i, j, sum(p * (1 - p) * v[i] * v[j]) as v from fitted{k}, range(1, {d + 2}) r(i), range(1, {d + 2}) c(j) group by i, j) group by i"""
        parts[f"slope{k}"] = f"select i, sum((p - y) * v[i]) as g from fitted{k}, range(1, {d + 2}) r(i) group by i"
        parts[f"solved{k}"] = f"""
select 1 as turn, i, list_append(h, -(g + case when i <= {d} then b[i] else 0 end)) as h from hessian{k} join slope{k} using (i), beta{k}
union all
select turn + 1, i, case when i = turn then list_transform(h, lambda x: x / h[turn])
  else list_transform(list_zip(h, top), lambda z: z[1] - z[2] * (h[turn] / top[turn])) end
from (select *, max(case when i = turn then h end) over () as top from solved{k}) where turn <= {d + 1}"""
        parts[f"beta{k + 1}"] = f"select list(b[i] + h[{d + 2}] order by i) as b from solved{k}, beta{k} where turn = {d + 2}"
    parts["beta"] = f"select b from beta{NEWTON_STEPS}"
    parts["test"] = "select AccountId, HasFraud, 1 / (1 + exp(-list_dot_product(v, b))) as p from inputs, beta where split = 'test'"
    return parts


def with_recursive(parts: dict[str, str], final: str) -> str:
    return "with recursive " + ",\n".join(f"{n} as materialized ({q})" if "solved" not in n else f"{n} as ({q})" for n, q in parts.items()) + "\n" + final


FRAUD_RATE = "select AccountId, TotalFraudTransactions / Frequency as p from f"
SCORED = {"r": FRAUD_RATE, "k": f"select AccountId, p, {SCORE} as credit_score from r"}
TERMS = (
    f"{terms(1)} as recommended_loan_amount, {terms(2)} as recommended_loan_duration, "
    f"{terms(3)} as interest_rate_tier"
)

JUDGED = {
    **feature_parts(LINES),
    "j": """select AccountId, HasFraud, floor(MinAmount * 100 / (MaxValue + 1)) / 100 as p,
  cast(floor(MinAmount * 100 / (MaxValue + 1)) / 100 >= 0.05 as int) as prediction from f""",
    "g": "select p, sum(HasFraud) as pos, count(*) - sum(HasFraud) as neg from j group by p",
    "c": """select p, pos, neg, sum(pos) over (order by p desc) as tp, sum(neg) over (order by p desc) as fp,
  sum(pos) over () as all_pos, sum(neg) over () as all_neg from g""",
}


def report_line(c: int) -> str:
    return f"""select '{c}' as "class",
  coalesce(sum((HasFraud={c} and prediction={c})::int) / nullif(sum((prediction={c})::int), 0), 0) as "precision",
  coalesce(sum((HasFraud={c} and prediction={c})::int) / nullif(sum((HasFraud={c})::int), 0), 0) as recall,
  coalesce(2 * sum((HasFraud={c} and prediction={c})::int)
    / nullif(sum((prediction={c})::int) + sum((HasFraud={c})::int), 0), 0) as f1,
  cast(sum((HasFraud={c})::int) as bigint) as support from j"""


def average_line(name: str, weight_sql: str) -> str:
    means = ", ".join(f'sum({c} * {weight_sql}) / sum({weight_sql}) as {c}' for c in ('"precision"', "recall", "f1"))
    return f"select '{name}' as \"class\", {means}, cast(sum(support) as bigint) as support from lines_"


ORACLE: dict[str, str] = {}

ORACLE["txn_time_parts"] = f"""
select TransactionId, cast(hour(TransactionStartTime) as int) as TransactionHour,
  cast(day(TransactionStartTime) as int) as TransactionDayOfMonth,
  cast(isodow(TransactionStartTime)-1 as int) as TransactionDayOfWeek,
  cast(month(TransactionStartTime) as int) as TransactionMonth,
  cast(year(TransactionStartTime) as int) as TransactionYear from ({EVENTS})"""
ORACLE["txn_validate_rejects"] = f"""
select cast(TransactionId as varchar) as TransactionId, 'CurrencyCode: missing' as problems
from ({EVENTS}) where CurrencyCode is null"""
_TXN = ", ".join(f"round(3e-7+{c},4) as {c}" if c in ("Amount", "Value") else c for c in COLUMNS)
ORACLE["txn_validate_accepted"] = f"select {_TXN} from ({EVENTS}) where CurrencyCode is not null"
ORACLE["csv_transactions"] = f"select {_TXN} from ({EVENTS})"
ORACLE["json_transactions"] = ORACLE["csv_transactions"]
ORACLE["csv_rejects"] = f"""
select cast(TransactionId as varchar) as TransactionId, case when TransactionId % 50 = 0 then 'line: broken'
  else concat_ws(', ', case when CurrencyCode is null then 'CurrencyCode: missing' end,
    case when TransactionId % 50 = 1 then 'Value: invalid' end) end as problems,
  case when TransactionId % 50 = 0 then concat_ws(',', TransactionId, BatchId, AccountId) end as line
from ({EVENTS}) where TransactionId % 50 in (0, 1) or CurrencyCode is null"""
ORACLE["json_rejects"] = f"""
select case when TransactionId % 50 = 0 then 'line: broken' else 'CurrencyCode: missing' end as problems,
  cast(case when TransactionId % 50 = 0 then 40 end as int) as line_length, count(*) as n
from ({EVENTS}) where TransactionId % 50 = 0 or CurrencyCode is null group by all"""
ORACLE["distinct_accounts"] = f"select distinct AccountId from ({LINES})"

ORACLE["account_rfm"] = features_sql(LINES, ["Recency", "Frequency", "Monetary", "HasFraud"])
ORACLE["account_spend_stats"] = features_sql(
    LINES, ["AvgAmount", "MaxValue", "MinAmount", "StdAmount", "TotalFraudTransactions"]
)
ORACLE["account_distincts"] = features_sql(LINES, [c for c in FEATURES if c.startswith("Unique")])
ORACLE["account_distincts_of_period"] = features_sql(
    f"select * from ({LINES}) where cast(TransactionStartTime as date) between '1995-01-01' and '1997-12-31'",
    [c for c in FEATURES if c.startswith("Unique")],
)
ORACLE["account_modes"] = features_sql(LINES, [c for c in FEATURES if c.startswith("MostFrequent")])
ORACLE["account_time_stats"] = features_sql(
    EVENTS, [c for c in FEATURES if "Transaction" in c and c != "TotalFraudTransactions"]
)
ORACLE["account_features"] = features_sql(LINES)
ORACLE["account_features_events"] = features_sql(EVENTS)
ORACLE["account_features_own_reference"] = features_sql(EVENTS, now="max(TransactionStartTime)")
ORACLE["rfm_summary_signed"] = features_sql(LINES, RFM_SUMMARY, amount="Amount")
ORACLE["head_accounts"] = features_sql(LINES) + " order by AccountId limit 5"

_TYPES = {f.name: f.dataType.simpleString() for f in TRANSACTIONS}
ORACLE["profile_overview"] = with_(
    {"t": EVENTS},
    " union all ".join(
        f"select '{c}' as \"column\", '{_TYPES[c]}' as dtype, count({c}) as non_null, count(*) as row_count, "
        f"{len(COLUMNS)} as column_count from t"
        for c in COLUMNS
    ),
)
ORACLE["profile_describe"] = with_(
    {"t": LINES, "v": melted("t", NUMERIC)},
    """select "column", count(value) as count, round(3e-7+avg(value),4) as mean, round(3e-7+stddev_samp(value),4) as std,
  round(3e-7+min(value),4) as min, round(3e-7+quantile_cont(value,0.25),4) as q25, round(3e-7+quantile_cont(value,0.5),4) as q50,
  round(3e-7+quantile_cont(value,0.75),4) as q75, round(3e-7+max(value),4) as max from v group by "column\"""",
)
_RANGES = """select "column", case when min(value)=max(value) then min(value)-0.5 else min(value) end as lo,
  case when min(value)=max(value) then max(value)+0.5 else max(value) end as hi from v group by "column\""""
ORACLE["profile_histogram"] = with_(
    {
        "t": LINES,
        "v": melted("t", PLOTTED),
        "r": _RANGES,
        "e": """select "column", cast(i as int) as bin, lo+i*((hi-lo)/50) as low,
  case when i = 49 then hi else lo+(i+1)*((hi-lo)/50) end as high from r, range(50) g(i)""",
    },
    """select e."column", bin, round(3e-7+low,4) as bin_start, round(3e-7+high,4) as bin_end, count(value) as count
from e left join v on e."column" = v."column" and value >= low and (value < high or bin = 49)
group by e."column", bin, low, high""",
)
ORACLE["profile_kde"] = with_(
    {
        "t": LINES,
        "v": f'select "column", value, count(*) as c from ({melted("t", PLOTTED)}) where value is not null group by all',
        "b": f"""select "column", min(value) as lo, (max(value)-min(value))/{KDE_POINTS - 1} as step, count(value) as n,
  stddev_samp(value)*pow(count(value),-0.2) as h from ({melted("t", PLOTTED)}) group by "column" having stddev_samp(value) > 0""",
        "x": f'select b.*, cast(i as int) as point from b, range({KDE_POINTS}) g(i)',
    },
    """select "column", point, round(3e-12+lo+step*point,9) as x,
  round(3e-12+sum(c*exp(-0.5*((lo+step*point-value)/h)*((lo+step*point-value)/h)))/(n*h*sqrt(2*pi())),9) as density
from x join v using ("column") group by "column", point, lo, step, n, h""",
)


def _share(source: str, label: str, parts: dict[str, str]) -> str:
    return with_(
        parts,
        " union all ".join(
            f'select {c} as "class", count(*) filter (where {label}={c}) as count, '
            f"round(3e-7+100.0*count(*) filter (where {label}={c})/count({label}),4) as percent from {source}"
            for c in (0, 1)
        ),
    )


ORACLE["profile_class_share"] = _share("t", "FraudResult", {"t": LINES})
ORACLE["account_class_share"] = _share("f", "HasFraud", feature_parts(LINES))
ORACLE["profile_value_counts"] = with_(
    {"t": EVENTS, "v": melted("t", TEXT, dtype="varchar")},
    'select "column", value, count(*) as count from v where value is not null group by "column", value',
)
_BOTH = """count(*) filter (where FraudResult=0) as fraud_0, count(*) filter (where FraudResult=1) as fraud_1,
  count(*) filter (where FraudResult not in (0,1)) as fraud_other"""
ORACLE["profile_category_by_fraud"] = with_(
    {"t": EVENTS, "v": melted("t", TEXT, keep="FraudResult, ", dtype="varchar")},
    f'select "column", value, {_BOTH} from v where value is not null group by "column", value',
)
ORACLE["profile_corr_matrix"] = correlations({"t": LINES}, "t", NUMERIC)
ORACLE["profile_corr_label"] = correlations({"t": LINES}, "t", NUMERIC, "FraudResult")
ORACLE["profile_missing"] = with_(
    {"t": EVENTS, "v": melted("t", COLUMNS, dtype="varchar")},
    """select "column", count(*)-count(value) as missing_count, round(3e-7+100.0*(count(*)-count(value))/count(*),4) as missing_percent
from v group by "column" having count(*) > count(value)""",
)
_HOLES = f"""
select * replace (case when TransactionId % 3 > 0 then Value end as Value, case when TransactionId % 5 > 0 then ChannelId end as ChannelId,
  case when TransactionId % 5 > 0 then AccountId end as AccountId) from ({EVENTS})"""
ORACLE["profile_missing_order"] = with_(
    {"t": _HOLES, "v": melted("t", COLUMNS, dtype="varchar")},
    """select row_number() over (order by count(value), "column") - 1 as position, "column" from v group by "column" having count(*) > count(value)""",
)
ORACLE["profile_box_stats"] = box_sql({"t": LINES}, melted("t", PLOTTED))
ORACLE["profile_outlier_rows"] = with_(
    {"t": EVENTS, "v": melted("t", PLOTTED, keep="TransactionId, "), "q": quartiles()},
    """select TransactionId, "column", round(3e-7+value,4) as value from v join q using ("column")
where value < q1-1.5*(q3-q1) or value > q3+1.5*(q3-q1)""",
)
ORACLE["fraud_by_hour"] = (
    f"select cast(hour(TransactionStartTime) as int) as hour, {_BOTH} from ({EVENTS}) group by 1"
)
ORACLE["fraud_by_weekday"] = (
    f"select cast(isodow(TransactionStartTime)-1 as int) as weekday, {_BOTH} from ({EVENTS}) group by 1"
)
_SIGNED = feature_parts(LINES, amount="Amount")
ORACLE["account_box_by_fraud"] = box_sql(
    _SIGNED,
    melted(
        "f",
        ["Recency", "Frequency", "Monetary", "AvgAmount", "MaxValue", "UniqueProductCategories", "UniqueChannels"],
        keep="HasFraud, ",
    ),
    by="HasFraud",
)
_ACCOUNT_NUMERIC = ["AccountId", *RFM_SUMMARY]
ORACLE["account_corr_matrix"] = correlations(_SIGNED, "f", _ACCOUNT_NUMERIC)
ORACLE["account_corr_label"] = correlations(_SIGNED, "f", _ACCOUNT_NUMERIC, "HasFraud")

ORACLE["align_columns"] = with_(
    feature_parts(LINES),
    "select AccountId, Recency, 0 as MostFrequentChannel_PayLater, round(3e-7+Monetary,4) as Monetary, Frequency from f",
)
# The text categories of the sample tables.
CATEGORIES = {
    "MostFrequentChannel": ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"),
    "MostFrequentProductCategory": ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"),
    "MostFrequentCurrencyCode": ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"),
}
_DUMMIES = ", ".join(
    f"cast({c} = '{v}' as int) as \"{c}_{v}\"" for c, values in CATEGORIES.items() for v in values
)
ORACLE["one_hot_modes"] = with_(feature_parts(LINES), f"select AccountId, Frequency, {_DUMMIES} from f")
_PLACES = ", ".join(
    f"(select count(distinct {c}) from f) - (select count(distinct {c}) from f y where y.{c} >= x.{c}) as {c}_place" for c in MODES
)
ORACLE["one_hot_places"] = with_(feature_parts(LINES), f"select AccountId, Frequency, {_PLACES} from f x")
ORACLE["impute_median"] = with_(
    {
        "t": EVENTS,
        "x": """select TransactionId, case when CurrencyCode is not null then Amount end as Amount,
  case when CurrencyCode <> 'UGX' then Value end as Value from t""",
    },
    """select TransactionId, round(3e-7+coalesce(Amount,(select median(Amount) from x)),4) as Amount,
  round(3e-7+coalesce(Value,(select median(Value) from x)),4) as Value from x""",
)
_NUM = ", ".join(f"{scaled(c)} as num__{c}" for c in MODEL_NUMERIC)
ORACLE["standardize"] = with_(
    {**feature_parts(LINES), **numeric_stats_parts("f", MODEL_NUMERIC)}, f"select AccountId, {_NUM} from f"
)
_SCALED = ["Monetary", "AvgAmount", "StdAmount"]
ORACLE["rescale"] = with_(
    {
        **feature_parts(LINES),
        "once": "select AccountId, "
        + ", ".join(f"({c}-avg({c}) over ())/stddev_pop({c}) over () as {c}" for c in _SCALED)
        + " from f",
    },
    "select AccountId, "
    + ", ".join(f"round(3e-7+({c}-avg({c}) over ())/stddev_pop({c}) over (),4) as {c}" for c in _SCALED)
    + " from once",
)
_WOE_CANDIDATES = ["AccountId", *[c for c in FEATURES if c != "HasFraud"]]
ORACLE["woe_auto_columns"] = with_(
    {
        **feature_parts(LINES),
        "few": " union all ".join(
            f"select {i} as place, '{c}' as feature, "
            + ("count(*) > 0" if c in MODES else f"count(distinct {c}) < {FEW_VALUES}")
            + " as chosen from f"
            for i, c in enumerate(_WOE_CANDIDATES)
            if c not in DOUBLES
        ),
    },
    "select cast(row_number() over (order by place) - 1 as int) as position, feature from few where chosen",
)
ORACLE["woe_fit"] = with_(
    {**feature_parts(LINES), **woe_parts("f")},
    "select feature, category, n, bad, round(3e-9+woe,6) as woe from woe",
)
ORACLE["woe_transform"] = with_(
    {**feature_parts(LINES), **woe_parts("f")},
    f"select AccountId, {', '.join(f'{weight(c)} as {c}' for c in MODES)} from f x",
)
ORACLE["preprocess_all"] = with_(
    {
        **split_parts(),
        "train": "select * from s where split = 'train'",
        **numeric_stats_parts("train", MODEL_NUMERIC),
        **woe_parts("train"),
    },
    f"select AccountId, HasFraud, split, {_NUM}, {', '.join(f'{weight(c, 4)} as cat__{c}' for c in MODES)} from s x",
)

ORACLE["split_stratified"] = with_(split_parts(), "select AccountId, HasFraud, split from s")
ORACLE["split_roundtrip"] = with_(
    split_parts(), "select AccountId, HasFraud, round(3e-7+Monetary,4) as Monetary, split from s"
)
ORACLE["class_counts"] = with_(feature_parts(LINES), "select HasFraud, count(*) as n from f group by HasFraud")
ORACLE["class_weights"] = with_(
    feature_parts(LINES),
    """select HasFraud, count(*) as n, round(3e-9+sum(count(*)) over () / (count(*) over () * count(*)), 6) as weight
from f group by HasFraud""",
)
_OVERSAMPLED = {
    **feature_parts(LINES),
    "l": "select AccountId, HasFraud, round(3e-7+Monetary,4) as Monetary from f",
    "sizes": "select HasFraud, count(*) as c from l group by HasFraud",
    "minority": "select HasFraud, c from sizes order by c, HasFraud limit 1",
    "pool": f"""select l.*, row_number() over (order by {hash_sql('AccountId')}, AccountId) - 1 as row_
  from l where HasFraud = (select HasFraud from minority)""",
    "draws": f"""select {hash_sql('i')} % (select c from minority) as row_
  from (select unnest(range((select max(c) - min(c) from sizes))) as i)""",
    "o": "select * from l union all select AccountId, HasFraud, Monetary from draws join pool using (row_)",
}
ORACLE["oversample_minority"] = with_(_OVERSAMPLED, "select AccountId, HasFraud, Monetary from o")
ORACLE["oversampled_class_counts"] = with_(
    _OVERSAMPLED, "select HasFraud, count(*) as n from o group by HasFraud"
)
ORACLE["shuffled_rows"] = with_(
    feature_parts(LINES),
    f"select AccountId, HasFraud, row_number() over (order by {hash_sql('AccountId')}, AccountId) - 1 as position from f",
)
ORACLE["model_roundtrip"] = with_(split_parts(), "select AccountId, true as same from s where split = 'test'")
_INPUTS = [*[f"num__{c}" for c in MODEL_NUMERIC], *[f"cat__{c}" for c in MODES], "intercept"]
ORACLE["lr_optimality"] = " union all ".join(f"select '{c}' as feature, cast(0 as double) as gradient" for c in _INPUTS)
ORACLE["score_odd_probabilities"] = with_(
    feature_parts(EVENTS),
    """select AccountId, case AccountId%6 when 4 then 'score_undefined' when 5 then 'ok' else 'error' end as status,
  case when AccountId%6 = 5 then 600 end as credit_score from f""",
)
ORACLE["woe_absent_column"] = with_(
    {**feature_parts(LINES), **woe_parts("f")},
    f"select AccountId, {weight(MODES[0])} as {MODES[0]}, cast(0 as double) as {MODES[1]} from f x",
)

ORACLE["score_from_probability"] = with_(
    {**feature_parts(EVENTS), **SCORED}, "select AccountId, round(3e-9+p,6) as p, credit_score from k"
)
ORACLE["loan_terms"] = with_(
    {**feature_parts(LINES), **SCORED}, f"select AccountId, credit_score, {TERMS} from k"
)
ORACLE["score_report"] = with_(
    {**feature_parts(LINES), **SCORED},
    f"""select AccountId, round_even(p,4) as risk_probability, credit_score, {TERMS},
  case when credit_score is null then 'a probability of 1 has no score' else 'Prediction successful.' end as message from k""",
)

ORACLE["roc_auc"] = with_(
    JUDGED,
    "select round(3e-9+sum(neg * (tp - pos + pos / 2)) / (max(all_pos) * max(all_neg)), 6) as roc_auc from c",
)
ORACLE["pr_curve"] = with_(
    JUDGED,
    """select round(3e-9+p,6) as threshold, round(3e-9+tp/(tp+fp),6) as "precision", round(3e-9+tp/all_pos,6) as recall from c
union all select null, 1.0, 0.0""",
)
ORACLE["pr_auc"] = with_(
    {
        **JUDGED,
        "e": """select p, tp/(tp+fp) as prec, tp/all_pos as rec from c
  union all select cast('infinity' as double), 1.0, 0.0""",
        "w": "select prec, rec, lag(prec) over (order by p desc) as prec_, lag(rec) over (order by p desc) as rec_ from e",
    },
    "select round(3e-9+sum((rec - rec_) * (prec + prec_) / 2), 6) as pr_auc from w where rec_ is not null",
)
ORACLE["classification_report"] = with_(
    {**JUDGED, "lines_": f"{report_line(0)} union all {report_line(1)}"},
    'select "class", round(3e-9+"precision",6) as "precision", round(3e-9+recall,6) as recall, round(3e-9+f1,6) as f1, support from ('
    "select * from lines_ union all select 'accuracy', null, null, avg((HasFraud=prediction)::int), count(*) from j "
    f"union all {average_line('macro avg', '1')} union all {average_line('weighted avg', 'support')})",
)
ORACLE["confusion_matrix"] = with_(
    JUDGED,
    " union all ".join(
        f"select {a} as actual, count(*) filter (where prediction=0) as predicted_0, "
        f"count(*) filter (where prediction=1) as predicted_1 from j where HasFraud={a}"
        for a in (0, 1)
    ),
)

# --- models ---------------------------------------------------------------

_FITTED = logit_parts()
ORACLE["lr_scores"] = with_recursive(
    _FITTED, "select AccountId, HasFraud, round(3e-9+p,6) as p, cast(p > 0.5 as double) as prediction from test"
)
_CURVE = {
    "g": "select round(p, 9) as p, sum(HasFraud) as pos, count(*) - sum(HasFraud) as neg from test group by 1",
    "c": JUDGED["c"],
    "e": """select p, tp/(tp+fp) as prec, tp/all_pos as rec from c
  union all select cast('infinity' as double), 1.0, 0.0""",
    "w": "select prec, rec, lag(prec) over (order by p desc) as prec_, lag(rec) over (order by p desc) as rec_ from e",
}
ORACLE["lr_evaluation"] = with_recursive(
    {**_FITTED, **_CURVE},
    """select round(3e-9+(select sum(neg * (tp - pos + pos / 2)) / (max(all_pos) * max(all_neg)) from c), 6) as roc_auc,
  round(3e-9+(select sum((rec - rec_) * (prec + prec_) / 2) from w where rec_ is not null), 6) as pr_auc""",
)


def scored_sql(features: str) -> str:
    """Responses for the account features in the table ``features``."""
    return f"""
select AccountId, round_even(p, 4) as risk_probability, credit_score, {TERMS}, 'Prediction successful.' as message, 'ok' as status
from (select AccountId, p, {SCORE} as credit_score from (
  select AccountId, 1 / (1 + exp(-list_dot_product({MODEL_INPUTS}, b))) as p from {features} x, beta))"""


# serving counts recency from the account's own latest transaction
ORACLE["score_transactions"] = with_recursive({**_FITTED, "own": "select * replace (0 as Recency) from f"}, scored_sql("own"))


def batch_sql(records: str) -> str:
    """Responses for a batch of records, accounts with refused ones among them."""
    parts = {
        **_FITTED,
        "records": records,
        "refused": "select distinct AccountId from records where CurrencyCode is null",
        **feature_parts("select * from records where CurrencyCode is not null", now="max(TransactionStartTime)", prefix="e_"),
        "accepted": "select * from e_f where AccountId not in (select AccountId from refused)",
    }
    refused = "select AccountId, null, null, null, null, null, 'record refused: CurrencyCode: missing', 'error' from refused"
    return with_recursive(parts, f"{scored_sql('accepted')} union all {refused}")


ORACLE["score_raw_records"] = batch_sql(EVENTS)
ORACLE["score_mixed_records"] = batch_sql(
    f"select * replace (case when AccountId % 3 > 0 then coalesce(CurrencyCode, 'XXX') else CurrencyCode end as CurrencyCode) from ({EVENTS})"
)
ORACLE["score_stream"] = ORACLE["score_raw_records"]
ORACLE["gbt_walk"] = ORACLE["model_roundtrip"]
ORACLE["stream_quarantine"] = f"select TransactionId, 'CurrencyCode: missing' as problems from ({EVENTS}) where CurrencyCode is null"
ORACLE["stream_counts"] = f"""
select count(*) as records, count(*) filter (where CurrencyCode is null) as refused, count(distinct AccountId) as accounts,
  count(distinct case when CurrencyCode is null then AccountId end) as errors from ({EVENTS})"""
