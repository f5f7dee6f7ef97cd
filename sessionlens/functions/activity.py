"""Codes of an activity row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LOGON, LOGOFF, CONNECT, DISCONNECT, HTTP, EMAIL, FILE = 1, 2, 3, 4, 5, 6, 7
ACTIVITY_CODES = {
    "logon": LOGON, "logoff": LOGOFF, "connect": CONNECT, "disconnect": DISCONNECT,
    "http": HTTP, "email": EMAIL, "file": FILE,
}
DEVICE_ACTIVITIES = ["Logon", "Logoff", "Connect", "Disconnect"]
PC_OWN, PC_SHARED, PC_OTHER, PC_SUPERVISOR = 0, 1, 2, 3


def activity_code(log: Column, activity: Column) -> Column:
    """Code of the activity where one is logged, else of the log itself; 0 for anything else."""
    name = F.when(activity.isin(DEVICE_ACTIVITIES), F.lower(F.trim(activity))).otherwise(log)
    code = F.lit(0)
    for value, number in ACTIVITY_CODES.items():
        code = F.when(name == value, number).otherwise(code)
    return code


def pc_code(pc: Column, own: Column, shared: Column, supervisor: Column) -> Column:
    """Whose computer a row was done on: own, shared, supervisor's or another one."""
    return (
        F.when(pc == own, PC_OWN)
        .when(F.array_contains(shared, pc), PC_SHARED)
        .when(pc == supervisor, PC_SUPERVISOR)
        .otherwise(PC_OTHER)
    )
