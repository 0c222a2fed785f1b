"""Life-cycle events of plugins, their phases, and kinds of plugin classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Event methods of each kind of plugin and when they run.
EVENTS: dict[str, dict[str, list[str]]] = {
    "form": {
        "none": ["registerListener"],
        "memory": [
            "afterCreateNewData", "beforeBindData", "afterBindData", "propertyChanged", "beforeFieldPostBack", "afterFieldPostBack",
            "itemClick", "click", "beforeItemClick", "beforeDoOperation", "afterDoOperation", "closedCallBack", "confirmCallBack", "beforeClosed",
        ],
    },
    "op": {
        "build": ["onPreparePropertys"],
        "validate": ["onAddValidators"],
        "transaction": [
            "beforeExecuteOperationTransaction", "afterExecuteOperationTransaction", "beginOperationTransaction", "endOperationTransaction",
        ],
        "none": ["rollbackOperation", "onReturnOperation"],
    },
    "convert": {"build": ["afterConvert", "beforeBuildRowMeta", "afterCreate", "beforeDoCreate", "afterCreateColumns"]},
    "writeback": {"transaction": ["writeBack", "beforeWriteBack", "afterWriteBack"]},
    "list": {"none": ["beforeCreateListDataProvider", "setFilter", "itemClick"], "memory": ["billListHyperLinkClick"]},
    "validator": {"validate": ["validate"]},
}
# Base classes and the kind of plugin that extends them.
BASES = {
    "AbstractFormPlugin": "form", "AbstractMobFormPlugin": "form", "AbstractBillPlugIn": "form", "AbstractMobBillPlugIn": "form",
    "AbstractBasePlugIn": "form", "AbstractListPlugin": "list", "AbstractTreeListPlugin": "list", "StandardTreeListPlugin": "list",
    "AbstractMobListPlugin": "list", "AbstractOperationServicePlugIn": "op", "AbstractValidator": "validator",
    "AbstractConvertPlugIn": "convert", "AbstractWriteBackPlugIn": "writeback", "BatchImportPlugin": "import",
    "AbstractBillWebApiPlugin": "webapi", "IBillWebApiPlugin": "webapi", "AbstractWebApiPlugin": "webapi", "AbstractTask": "task",
    "AbstractPrintServicePlugin": "print", "AbstractPrintPlugin": "print", "IWorkflowPlugin": "workflow",
}
REGISTERED = ["form", "list", "op", "writeback", "convert"]
_RANK = ["transaction", "build", "validate", "memory", "none"]


def event_table(spark: SparkSession) -> DataFrame:
    """(kind, event, phase), and kind ``unknown`` with the strongest phase of any kind."""
    rows = [(kind, name, phase) for kind, phases in EVENTS.items() for phase, names in phases.items() for name in names]
    strongest: dict[str, str] = {}
    for _, name, phase in rows:
        if name not in strongest or _RANK.index(phase) < _RANK.index(strongest[name]):
            strongest[name] = phase
    return spark.createDataFrame([*rows, *(("unknown", n, p) for n, p in strongest.items())], "kind string, event string, phase string")


def base_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BASES.items()), "base string, base_kind string")


def plugin_kind(plugin_type: Column, base_kind: Column) -> Column:
    """struct(kind, confidence): as registered, else by the base class."""
    known = plugin_type.isin(REGISTERED)
    return (
        F.when(known & base_kind.isNotNull() & (base_kind != plugin_type), F.struct(plugin_type.alias("kind"), F.lit(0.8).alias("confidence")))
        .when(known, F.struct(plugin_type.alias("kind"), F.lit(0.95).alias("confidence")))
        .when(base_kind.isNotNull(), F.struct(base_kind.alias("kind"), F.lit(0.7).alias("confidence")))
        .otherwise(F.struct(F.lit("unknown").alias("kind"), F.lit(0.0).alias("confidence")))
    )
