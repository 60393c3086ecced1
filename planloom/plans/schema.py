"""Schemas of plan logs, plan nodes and learnt parameters, and the vocabulary of plan nodes."""

from __future__ import annotations

PLAN_LOG = "seqid bigint, starttime timestamp, endtime timestamp, database string, pid int, nested_level int, queryid string, query string, planid string, plan string, plan_json string"
SNAPSHOT = "pid int, database string, worker_type string, nested_level int, queryid string, query_start timestamp, query string, planid string, plan string, plan_json string"
REG = "queryid string, sort_space_used int, params string"

#: One row for each node of a plan; node_no counts from 1 in pre-order.
NODE = (
    "node_no int, parent_no int, child_ix int, depth int, last_no int, relationship string, node_type string, strategy string, partial_mode string, join_type string, "
    "plan_rows double, actual_rows double, actual_loops double, removed_rows double, workers_planned int, workers_launched int, "
    "workers array<struct<no:int,rows:double,loops:double>>, merge_flag boolean, norm int, norm_plan int, "
    "schema string, relation string, alias string, relations array<string>, sort_space_kb bigint, sort_space_type string, "
    "conds array<struct<kind:string,expr:string>>, props map<string,string>"
)
PLAN_NODE = "server_id string, seqid bigint, queryid string, planid string, " + NODE
#: Rows of a node's children (outer, inner, and all members) and the relations below either side.
INPUTS = "plan_outer double, actual_outer double, plan_inner double, actual_inner double, plan_members double, actual_members double, outer_rels array<string>, inner_rels array<string>"

# Names that plan documents use.
CONDITIONS = ["Index Cond", "Recheck Cond", "TID Cond", "Merge Cond", "Hash Cond", "Filter", "Join Filter"]
FINGERPRINT_CONDITIONS = [*CONDITIONS, "Conflict Filter"]
REMOVED = ["Rows Removed by Filter", "Rows Removed by Join Filter", "Rows Removed by Index Recheck", "Rows Removed by Conflict Filter"]
SCANS = ["Seq Scan", "Sample Scan", "Index Scan", "Index Only Scan", "Bitmap Index Scan", "Bitmap Heap Scan", "Tid Scan", "Tid Range Scan", "Subquery Scan", "Function Scan", "Table Function Scan", "Values Scan", "CTE Scan", "Named Tuplestore Scan", "WorkTable Scan", "Foreign Scan", "Custom Scan"]
#: Joins whose output is modelled as the product of its inputs, and those modelled as a sum.
PRODUCT_NODES = ["Append", "Merge Append", "Recursive Union", "Nested Loop", "BitmapAnd", "BitmapOr"]
MEMBER_NODES = ["Append", "Merge Append", "BitmapAnd", "BitmapOr"]
SUM_JOINS = ["Hash Join", "Merge Join"]
JOINS = ["Nested Loop", *SUM_JOINS]
SORTS = ["Sort", "Incremental Sort"]
#: The keys whose text values make up a plan's fingerprint.
STRUCTURAL = [
    "Node Type", "Parent Relationship", "Relation Name", "Function Name", "Index Name", "CTE Name", "Relation", "Schema", "Alias", "Output", "Scan Direction", "Strategy", "Join Type", "Sort Key", "Operation", "Subplan Name", "Command",
    "Triggers", "Trigger", "Trigger Name", "Constraint Name", "Group Key", "Grouping Sets", "Group Keys", "Hash Keys", "Hash Key", "Partial Mode", "Inner Unique",
]
