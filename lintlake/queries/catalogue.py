"""All registered queries."""

from lintlake.queries import findings, flows, ingest, network, remediation, reports, scan  # noqa: F401
from lintlake.queries.registry import ORACLES, QUERIES  # noqa: F401
