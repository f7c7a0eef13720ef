"""Independent SQL for every registered query that SQL can express."""

from usagelens.plans.oracle.analytics import CUSTOMERS, MODELS, PRICING
from usagelens.plans.oracle.hazard import HAZARD
from usagelens.plans.oracle.layers import ATTEMPTS, FILTERED, HEADLINE, QUALITY, SOURCES, STAR, WHAT_IF
from usagelens.plans.oracle.personas import PERSONAS
from usagelens.plans.oracle.reports import REPORTS

ORACLE: dict[str, str] = {
    **SOURCES,
    **REPORTS,
    **CUSTOMERS,
    **PERSONAS,
    **HAZARD,
    **MODELS,
    **PRICING,
    **FILTERED,
    **WHAT_IF,
    **STAR,
    **ATTEMPTS,
    **QUALITY,
    **HEADLINE,
}
