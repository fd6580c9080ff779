"""Queries over settled claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from trenchline.operators import ownership
from trenchline.plans.pipeline import Job
from trenchline.plans.registry import query


@query("owned_stretches")
def owned_stretches(spark, sf_dir):
    return Job.of(spark, sf_dir).owned.select(
        "project_id", "group_id", "route_id", "start_ft", "end_ft", "window_score", "combined", "accepted", "reselected", "reason")


@query("owned_stretches_input_order")
def owned_stretches_input_order(spark, sf_dir):
    job = Job.of(spark, sf_dir)
    return ownership.resolve(job.claims, input_order=True).select(
        "project_id", "group_id", "route_id", "start_ft", "end_ft", "accepted", "reselected", "reason")


@query("claim_conflicts")
def claim_conflicts(spark, sf_dir):
    job = Job.of(spark, sf_dir)
    zones = job.claims.select("project_id", "group_id", "sheets", "streets")
    return ownership.conflict_pairs(job.owned.where("accepted").join(zones, ["project_id", "group_id"])).select(
        "project_id", "route_id", "a_group_id", "b_group_id", "overlap_ft", "overlap_ratio", "centre_gap_ft", "span_similarity", "near_duplicate",
        "conflict", "same_zone")
