"""Wait-type vocabulary: exclusion presets, probable causes, next steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetgauge.functions.numbers import as_col

# The idle wait types each report leaves out.
IDLE_FULL = (
    "SLEEP_TASK", "BROKER_TO_FLUSH", "BROKER_TASK_STOP", "CLR_AUTO_EVENT",
    "DISPATCHER_QUEUE_SEMAPHORE", "FT_IFTS_SCHEDULER_IDLE_WAIT", "HADR_WORK_QUEUE",
    "LAZYWRITER_SLEEP", "LOGMGR_QUEUE", "ONDEMAND_TASK_QUEUE",
    "REQUEST_FOR_DEADLOCK_MONITOR", "RESOURCE_QUEUE", "SERVER_IDLE_CHECK",
    "SLEEP_DBSTARTUP", "SLEEP_DBRECOVER", "SLEEP_MASTERDBREADY", "SLEEP_MASTERMDREADY",
    "SLEEP_MASTERUPGRADED", "SLEEP_MSDBSTARTUP", "SLEEP_SYSTEMTASK",
    "SLEEP_TEMPDBSTARTUP", "SNI_HTTP_ACCEPT", "SP_SERVER_DIAGNOSTICS_SLEEP",
    "SQLTRACE_BUFFER_FLUSH", "WAITFOR", "XE_DISPATCHER_WAIT", "XE_TIMER_EVENT",
    "BROKER_EVENTHANDLER", "CHECKPOINT_QUEUE", "DBMIRROR_EVENTS_QUEUE",
    "SQLTRACE_INCREMENTAL_FLUSH_SLEEP",
)
IDLE_COLLECTOR = (
    "SLEEP_TASK", "LAZYWRITER_SLEEP", "LOGMGR_QUEUE", "WAITFOR", "XE_DISPATCHER_WAIT",
    "CHECKPOINT_QUEUE",
)
IDLE_PLAYBOOK = (
    "SLEEP_TASK", "LAZYWRITER_SLEEP", "LOGMGR_QUEUE", "WAITFOR", "XE_DISPATCHER_WAIT",
    "XE_TIMER_EVENT", "BROKER_EVENTHANDLER", "CHECKPOINT_QUEUE",
)
IDLE_PATTERNS = ("SLEEP%", "%IDLE%", "%QUEUE%")
BASELINE_WAITS = (
    "PAGEIOLATCH_SH", "PAGEIOLATCH_EX", "WRITELOG", "LCK_M_S", "LCK_M_X", "LCK_M_U", "CXPACKET",
)
IO_LATCH = ("PAGEIOLATCH_SH", "PAGEIOLATCH_EX")
# In LIKE the underscores of LCK_M_% match any one character.
LOCK_PATTERN = "LCK_M_%"


def active_waits(exclude=IDLE_FULL, patterns=()) -> Column:
    """Predicate that keeps the wait types worth reporting."""
    keep = ~F.upper("wait_type").isin(*exclude) if exclude else F.lit(True)
    for pattern in patterns:
        keep = keep & ~F.col("wait_type").ilike(pattern)
    return keep


def cause(wait_type="wait_type", extended: bool = True) -> Column:
    """Probable cause of a wait; the short form knows fewer wait types."""
    w = F.upper(as_col(wait_type))
    parallel = ["CXPACKET", "CXSYNC_PORT"] + (["CXSYNC_CONSUMER"] if extended else [])
    chain = (
        F.when(w.isin(*IO_LATCH), "slow_disk_or_missing_index")
        .when(w.isin(*parallel), "parallelism")
        .when(w == "SOS_SCHEDULER_YIELD", "cpu_pressure")
        .when(w == "WRITELOG", "slow_log")
        .when(w == "RESOURCE_SEMAPHORE", "memory_shortage")
        .when(w.ilike(LOCK_PATTERN), "blocking")
        .when(w == "ASYNC_NETWORK_IO", "slow_client")
    )
    if extended:
        chain = chain.when(w == "BACKUPIO", "backup_running")
    return chain.otherwise("look_up")


def next_report(wait_type="wait_type") -> Column:
    """Which report to read next for a dominant wait."""
    w = F.upper(as_col(wait_type))
    return (
        F.when(w.startswith("PAGEIOLATCH"), "missing_indexes,fragmentation")
        .when(w == "CXPACKET", "raise_cost_threshold")
        .when(w.startswith("SOS_SCHEDULER"), "heavy_queries")
        .when(w == "WRITELOG", "file_latency")
        .when(w == "RESOURCE_SEMAPHORE", "memory_grants,server_memory")
        .when(w.ilike(LOCK_PATTERN), "blocking")
        .when(w.startswith("ASYNC_NETWORK"), "client_application")
        .otherwise("look_up")
    )
