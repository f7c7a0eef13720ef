"""Domain schemas and the fixed values every operator shares."""

from __future__ import annotations

from pyspark.sql import types as T

FREE = "Free"
MONEY = T.DecimalType(18, 2)
RUN_COST = T.DecimalType(18, 8)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_TEXT, _INT, _LONG, _DOUBLE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
_DATE, _TIME = T.DateType(), T.TimestampNTZType()

PLANS = _schema(
    plan=_TEXT,
    monthly_fee_usd=MONEY,
    included_credits=_INT,
    overage_usd_per_credit=T.DecimalType(6, 2),
)

MODELS = _schema(
    model=_TEXT,
    usd_per_m_input=T.DecimalType(8, 2),
    usd_per_m_output=T.DecimalType(8, 2),
    sec_per_step=_DOUBLE,
)

CUSTOMERS = _schema(
    customer_id=_TEXT,
    company_name=_TEXT,
    signup_date=_DATE,
    industry=_TEXT,
    company_size=_TEXT,
    region=_TEXT,
    acquisition_channel=_TEXT,
    is_sales_led=_INT,
    first_paid_date=_DATE,
    current_plan=_TEXT,
    churn_date=_DATE,
    status=_TEXT,
)

CUSTOMER_MONTHS = _schema(
    customer_id=_TEXT,
    month=_DATE,
    plan=_TEXT,
    monthly_fee_usd=MONEY,
    included_credits=_INT,
    credits_used=_LONG,
    overage_credits=_LONG,
    overage_revenue_usd=MONEY,
    revenue_usd=MONEY,
)

AGENT_RUNS = _schema(
    run_id=_TEXT,
    customer_id=_TEXT,
    started_at=_TIME,
    task_type=_TEXT,
    source_stack=_TEXT,
    target_stack=_TEXT,
    model=_TEXT,
    plan_at_run=_TEXT,
    steps=_INT,
    input_tokens=_LONG,
    output_tokens=_LONG,
    llm_cost_usd=RUN_COST,
    latency_sec=_DOUBLE,
    lines_changed=_INT,
    tests_total=_INT,
    tests_passed=_INT,
    status=_TEXT,
    credits_charged=_INT,
    human_rating=_INT,
)

EXPERIMENT_ASSIGNMENTS = _schema(
    customer_id=_TEXT,
    experiment_name=_TEXT,
    assigned_at=_DATE,
    variant=_TEXT,
    pro_price_shown=_INT,
)

ATTEMPTS = _schema(
    model=_TEXT,
    task_id=_TEXT,
    task_type=_TEXT,
    repeat=_INT,
    status=_TEXT,
    tests_passed=_INT,
    tests_total=_INT,
    error_type=_TEXT,
    prompt_tokens=_LONG,
    output_tokens=_LONG,
    total_duration_sec=_DOUBLE,
    eval_duration_sec=_DOUBLE,
    tokens_per_sec=_DOUBLE,
    cost_usd=RUN_COST,
    code_extracted=T.BooleanType(),
    timestamp=_TIME,
)

TABLES = {
    "plans": PLANS,
    "models": MODELS,
    "customers": CUSTOMERS,
    "customer_months": CUSTOMER_MONTHS,
    "agent_runs": AGENT_RUNS,
    "experiment_assignments": EXPERIMENT_ASSIGNMENTS,
}

# The plan order, paid plans, outcome ordinals, migration task and the two
# task sets that count as "simple" (three tasks for the pricing scenarios, four elsewhere).
ALL_PLANS = ["Free", "Pro", "Team", "Enterprise"]
PAID_PLANS = ["Pro", "Team", "Enterprise"]
STATUSES = ["failed", "partial", "success"]
MIGRATION_TASK = "code_migration"
SIMPLE_TASKS_PRICING = ["test_generation", "bug_fix", "dependency_upgrade"]
SIMPLE_TASKS = ["test_generation", "bug_fix", "refactor", "dependency_upgrade"]
FRONTIER_MODEL = "frontier-large"
BALANCED_MODEL = "balanced-medium"
