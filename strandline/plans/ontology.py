"""Ontology of the claim graph: predicates, source trust, field maps."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Node types, structural edges, predicate vocabulary (domain, range,
# temporal, cardinality, inverse, remap), arbitration weights and source trust.
NODE_TYPES = ("Person", "Alias", "Team", "Project", "Account", "Artifact", "Decision", "Topic", "Claim", "Group")
STRUCTURAL_EDGES = ("ALIAS_OF", "ABOUT", "OBJECT", "SOURCED_FROM", "ASSERTED_BY", "SUPERSEDES", "CONTRADICTS", "VISIBLE_TO")
PREDICATES = {
    "ASSIGNED_TO": (("Artifact", "Project", "Decision"), ("Person",), True, "one", None, {"Project": "OWNED_BY", "Account": "OWNED_BY"}),
    "OWNED_BY": (("Project", "Account", "Artifact"), ("Person", "Team"), True, "one", "OWNS", {}),
    "REPORTS_TO": (("Person",), ("Person",), True, "one", None, {}),
    "STATUS_IS": (("Project", "Artifact", "Decision"), ("Topic",), True, "one", None, {}),
    "DUE_ON": (("Project", "Artifact"), ("Topic",), True, "one", None, {}),
    "PRIORITY_IS": (("Project", "Artifact"), ("Topic",), True, "one", None, {}),
    "BUDGET_IS": (("Project", "Account"), ("Topic",), True, "one", None, {}),
    "SCHEDULED_FOR": (("Artifact", "Project"), ("Topic",), True, "one", None, {}),
    "RESOLVED_BY": (("Artifact",), ("Person",), True, "one", None, {}),
    "OWNS": (("Person", "Team"), ("Project", "Account", "Topic"), True, "many", "OWNED_BY", {}),
    "MEMBER_OF": (("Person",), ("Team", "Project"), True, "many", None, {}),
    "WORKS_ON": (("Person",), ("Project", "Topic"), True, "many", None, {}),
    "BLOCKS": (("Project", "Artifact"), ("Project", "Artifact"), True, "many", None, {}),
    "DEPENDS_ON": (("Project", "Artifact"), ("Project", "Artifact"), True, "many", None, {}),
    "CUSTOMER_OF": (("Account",), ("Project", "Team"), True, "many", None, {}),
    "ESCALATED_TO": (("Artifact", "Account"), ("Person", "Team"), True, "many", None, {}),
    "RISK_OF": (("Project", "Account"), ("Topic",), True, "many", None, {}),
    "DECIDED": (("Person", "Team"), ("Decision",), False, "many", None, {}),
    "REVIEWED_BY": (("Artifact",), ("Person",), False, "many", None, {}),
    "AUTHORED": (("Person",), ("Artifact",), False, "many", None, {}),
    "MENTIONS": (("Artifact",), ("Person", "Project", "Account", "Topic"), False, "many", None, {}),
    "DISCUSSED_IN": (("Project", "Topic", "Account"), ("Artifact",), False, "many", None, {}),
    "REFERENCES": (("Artifact",), ("Artifact",), False, "many", None, {}),
}
WEIGHTS = {"authority": 0.35, "recency": 0.30, "specificity": 0.15, "corroboration": 0.15, "hedging": -0.05}
CONTESTED_MARGIN = 0.05
SUFFICIENCY = 0.35
SOURCE_AUTHORITY = {"jira": 1.00, "linear": 1.00, "github": 0.90, "hubspot": 0.90, "confluence": 0.80, "drive": 0.75, "fireflies": 0.70, "gmail": 0.60, "slack": 0.50}
DEFAULT_AUTHORITY = 0.5
HEDGES = ("i think", "maybe", "probably", "not sure", "iirc", "afaik", "might", "tentatively")

# Dotted paths of each tool's record, and its deterministic rules
# (subject path, subject type, predicate, object path, object type, time path).
_T = "Artifact"
SOURCES: dict[str, dict] = {
    "slack": dict(kind="message", doc_id="ts", title="channel", body="text", author="user", author_email="user_email", created_at="ts_iso", acl=["channel"], rules=[("user", "Person", "AUTHORED", "__self__", _T, None)]),
    "gmail": dict(kind="email", doc_id="message_id", title="subject", body="body", author="from", created_at="date", acl=[], participants=["to"], rules=[("from", "Person", "AUTHORED", "__self__", _T, None)]),
    "jira": dict(kind="ticket", doc_id="key", title="fields.summary", body="fields.description", author="fields.reporter.displayName", created_at="fields.created", updated_at="fields.updated", acl=["fields.project.key"], rules=[
        ("__self__", _T, "ASSIGNED_TO", "fields.assignee.displayName", "Person", "fields.updated"), ("__self__", _T, "STATUS_IS", "fields.status.name", "Topic", "fields.updated"), ("__self__", _T, "DUE_ON", "fields.duedate", "Topic", "fields.updated"),
        ("fields.assignee.displayName", "Person", "WORKS_ON", "fields.project.name", "Project", "fields.updated"), ("fields.project.name", "Project", "DISCUSSED_IN", "__self__", _T, None)]),
    "linear": dict(kind="ticket", doc_id="identifier", title="title", body="description", author="creator.name", created_at="createdAt", updated_at="updatedAt", acl=["team.key"], rules=[
        ("__self__", _T, "ASSIGNED_TO", "assignee.name", "Person", "updatedAt"), ("__self__", _T, "STATUS_IS", "state.name", "Topic", "updatedAt"), ("__self__", _T, "DUE_ON", "dueDate", "Topic", "updatedAt"),
        ("assignee.name", "Person", "WORKS_ON", "project.name", "Project", "updatedAt"), ("project.name", "Project", "SCHEDULED_FOR", "dueDate", "Topic", "updatedAt"), ("project.name", "Project", "DISCUSSED_IN", "__self__", _T, None)]),
    "github": dict(kind="pr", doc_id="number", title="title", body="body", author="user.login", created_at="created_at", updated_at="merged_at", acl=["repo"], rules=[("user.login", "Person", "AUTHORED", "__self__", _T, None), ("__self__", _T, "REVIEWED_BY", "reviewer.login", "Person", None)]),
    "confluence": dict(kind="doc", doc_id="id", title="title", body="body", author="author", created_at="created", updated_at="updated", acl=["space"], rules=[("author", "Person", "AUTHORED", "__self__", _T, None)]),
    "drive": dict(kind="doc", doc_id="file_id", title="name", body="content", author="owner", created_at="createdTime", updated_at="modifiedTime", acl=["drive_id"], rules=[("owner", "Person", "AUTHORED", "__self__", _T, None)]),
    "hubspot": dict(kind="deal", doc_id="deal_id", title="dealname", body="notes", author="owner", created_at="createdate", updated_at="hs_lastmodifieddate", acl=["pipeline"], rules=[("owner", "Person", "OWNS", "company", "Account", "hs_lastmodifieddate"), ("company", "Account", "CUSTOMER_OF", "product", "Project", "hs_lastmodifieddate")]),
    "fireflies": dict(kind="transcript", doc_id="meeting_id", title="title", body="transcript", author="organizer", created_at="date", acl=[], participants=["attendees"], rules=[("organizer", "Person", "AUTHORED", "__self__", _T, None)]),
}


@dataclass(frozen=True)
class Schema:
    """The vocabulary and policy a graph is built with."""

    predicates: dict = field(default_factory=lambda: PREDICATES)
    weights: dict = field(default_factory=lambda: WEIGHTS)
    margin: float = CONTESTED_MARGIN
    sufficiency: float = SUFFICIENCY
    authority: dict = field(default_factory=lambda: SOURCE_AUTHORITY)
    hedges: tuple = HEDGES
    sources: dict = field(default_factory=lambda: SOURCES)
    node_types: tuple = NODE_TYPES

    def is_temporal(self, p: str) -> bool:
        return p in self.predicates and self.predicates[p][2]

    def is_functional(self, p: str) -> bool:
        return p in self.predicates and self.predicates[p][3] == "one"

    def arbitrated(self) -> list[str]:
        return [p for p in self.predicates if self.is_temporal(p) and self.is_functional(p)]

    def predicate_table(self, spark: SparkSession) -> DataFrame:
        """predicate, domain, range, temporal, cardinality, inverse, remap: one row per predicate of the vocabulary."""
        rows = [(p, list(d), list(r), t, c, inv, remap) for p, (d, r, t, c, inv, remap) in self.predicates.items()]
        return spark.createDataFrame(rows, "predicate string, domain array<string>, range array<string>, temporal boolean, cardinality string, inverse string, remap map<string,string>")

    def describe(self) -> dict:
        return {"node_types": list(self.node_types), "predicates": sorted(self.predicates), "sources": {t: {"authority": self.authority.get(t, DEFAULT_AUTHORITY), "kind": s["kind"]} for t, s in self.sources.items()}, "arbitration": {"weights": self.weights, "contested_margin": self.margin}, "sufficiency_threshold": self.sufficiency}
