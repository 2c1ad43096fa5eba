from workload import audits, chains, histories, joins, tables, wides
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "audits", "chains", "histories", "joins", "tables", "wides"]
