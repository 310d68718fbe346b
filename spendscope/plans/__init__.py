"""All reports; importing this package registers them in ``REPORTS``."""

from spendscope.plans import (  # noqa: F401
    access,
    adoption,
    ai_usage,
    alerts,
    anomaly,
    cloud_cost,
    cluster_health,
    compute,
    cost,
    executive,
    governance,
    inputs,
    jobs,
    labels,
    lineage,
    marketplace,
    platform_ops,
    query_attribution,
    running,
    storage,
    streams,
)
from spendscope.plans.bundles import BUNDLES, bundle
from spendscope.plans.registry import REPORTS

__all__ = ["BUNDLES", "REPORTS", "bundle"]
