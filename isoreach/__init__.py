"""Spatial accessibility analytics as Spark DataFrame operators.

Surfaces are long tables: ``(cell_id, value)``, pair tables are
``(cell_id, facility_id, weight)``. An absent row means "missing", which is
not the same as a weight of zero.
"""

from isoreach.functions.decay import DEFAULT_SIGMA, calc_decay, decay_column
from isoreach.grid import GridSpec
from isoreach.operators.choice import calc_choice
from isoreach.operators.flow import gather_demand, gather_weighted, spread_weighted
from isoreach.operators.normalize import calc_normalize
from isoreach.operators.sampling import sample_pmf, transform_pmf
from isoreach.operators.summary import format_result, format_summary, summarize
from isoreach.plans.ifca import ifca
from isoreach.plans.models import AccessResult, compute_access, e2sfca, two_sfca
from isoreach.sources.tables import read_example

__all__ = [
    "AccessResult", "DEFAULT_SIGMA", "GridSpec", "calc_choice", "calc_decay", "calc_normalize", "compute_access", "decay_column", "e2sfca",
    "format_result", "format_summary", "gather_demand", "gather_weighted", "ifca", "read_example", "sample_pmf", "spread_weighted", "summarize",
    "transform_pmf", "two_sfca",
]
