"""Every analysis by id: what it is called, where it belongs, and how to run it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from httplens.operators import findings
from httplens.plans import digest, rollups
from httplens.plans.rules import RULES


@dataclass(frozen=True)
class Analysis:
    id: str
    category: str
    title: str
    run: Callable[..., DataFrame]


_GROUPED = (
    Analysis("R1", "Recon", "Hosts", rollups.hosts),
    Analysis("R2", "Recon", "URL inventory", rollups.url_inventory),
    Analysis("R3", "Recon", "Methods", rollups.methods),
    Analysis("R4", "Recon", "Response codes", rollups.statuses),
    Analysis("R5", "Recon", "Requests per minute", rollups.timeline),
    Analysis("A2", "Authentication", "Paths that both answer and refuse", rollups.mixed_auth_paths),
    Analysis("I1", "Input Surface", "Endpoints used with other methods than GET", rollups.non_get_endpoints),
    Analysis("I2", "Input Surface", "Endpoints with query parameters", rollups.query_endpoints),
    Analysis("E4", "Errors & Leakage", "Paths not found", rollups.not_found_paths),
    Analysis("O1", "OWASP Top 10", "A01: paths that both answer and refuse", rollups.broken_access_paths),
    Analysis("O6", "OWASP Top 10", "A07: where authentication keeps failing", rollups.auth_hotspots),
    Analysis("S2", "Security", "Paths that differ in a number", rollups.numeric_id_patterns),
    Analysis("D1", "Dashboard", "Overview", rollups.overview),
    Analysis("D2", "Dashboard", "Authentication failures", rollups.auth_failure_panel),
    Analysis("D3", "Dashboard", "Server errors", rollups.server_error_panel),
    Analysis("D4", "Dashboard", "Attack surface", rollups.attack_surface_panel),
    Analysis("D5", "Dashboard", "Largest responses", rollups.largest_response_panel),
    Analysis("D6", "Dashboard", "Paths worth a look", rollups.interesting_path_panel),
    Analysis("D7", "Dashboard", "Hosts", rollups.hosts_panel),
    Analysis("M1", "Summary", "Counters", digest.counters),
    Analysis("M2", "Summary", "Top hosts", digest.top_hosts),
    Analysis("M3", "Summary", "Top statuses", digest.top_statuses),
    Analysis("M4", "Summary", "Methods", digest.method_counts),
    Analysis("M5", "Summary", "Recent requests", digest.recent),
    Analysis("M6", "Summary", "Text digest", digest.digest),
    Analysis("F1", "Findings", "Rules matched by each request", findings.tag_findings),
    Analysis("F2", "Findings", "Requests matched by each rule", findings.finding_counts),
)

CATALOGUE: dict[str, Analysis] = {
    a.id: a
    for a in (*_GROUPED, *(Analysis(r.id, r.category, r.title, r.run) for r in RULES))
}


def categories() -> dict[str, list[Analysis]]:
    """The analyses by category, both in alphabetical order."""
    grouped: dict[str, list[Analysis]] = {}
    for analysis in sorted(CATALOGUE.values(), key=lambda a: (a.category, a.title)):
        grouped.setdefault(analysis.category, []).append(analysis)
    return grouped


def run(traffic: DataFrame, analysis_id: str, **options) -> DataFrame:
    return CATALOGUE[analysis_id].run(traffic, **options)
