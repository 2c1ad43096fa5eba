from tidescore.plans.manifest import ChangedStepError
from tidescore.plans.steps import ChainResult, Model, Step, run_chain, sql_frame, sql_step
from tidescore.plans.store import Events, History, Wide, store_results
from tidescore.plans.work_list import WorkFailed, update_work_list

__all__ = [
    "ChangedStepError",
    "ChainResult",
    "Events",
    "History",
    "Model",
    "Step",
    "Wide",
    "WorkFailed",
    "run_chain",
    "sql_frame",
    "sql_step",
    "store_results",
    "update_work_list",
]
