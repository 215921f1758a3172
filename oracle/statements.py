"""All statements by query name."""

from oracle import facts, kpis, metrics, quality, semantic

ALL: dict[str, str] = {**facts.SQL, **quality.SQL, **kpis.SQL, **metrics.SQL, **semantic.SQL}
