"""Who sees which document: one definition, as columns for filters and for single rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: kinds of documents and of users
PUBLIC, GROUP, PRIVATE, CLIENT = "internal_public", "internal_group", "internal_private", "client_private"
ALLOWED = {"internal": {PUBLIC, GROUP, PRIVATE, CLIENT}, "client": {CLIENT}}


def visible(kind: str, user_id: int, groups: list[int], for_list: bool = True, role: str | None = None, visibility: str = "visibility", owner: str = "owner_id", group: str = "group_id") -> Column:
    """A filter for one user: within a rule all conditions hold, and one rule is enough.

    Clients see their own documents. Internal users see public ones, their own, and those of their groups; an
    administrator also all clients' documents in lists, not in searches.
    """
    vis, own = F.col(visibility), F.col(owner) == user_id
    if kind == "client":
        return F.coalesce((vis == CLIENT) & own, F.lit(False))
    rules = [vis == PUBLIC, (vis == PRIVATE) & own]
    if groups:
        rules.append((vis == GROUP) & F.col(group).isin(groups))
    if for_list and role == "admin":
        rules.append(vis == CLIENT)
    return F.coalesce(reduce(lambda a, b: a | b, rules), F.lit(False))


def can_view(visibility: Column, owner: Column, group: Column, kind: Column, user_id: Column, groups: Column, role: Column) -> Column:
    """The same decision for a document and a user of one row, as a table of documents and users has them."""
    internal, mine = kind == "internal", owner == user_id
    by_kind = (
        F.when(visibility == PUBLIC, internal).when(visibility == GROUP, internal & F.array_contains(groups, group))
        .when(visibility == PRIVATE, internal & mine).when(visibility == CLIENT, mine | (internal & (role == "admin")))
    )
    return F.coalesce(by_kind, F.lit(False))


def placement_error(visibility: Column, group: Column, kind: Column, role: Column, groups: Column) -> Column:
    """Why a user may not file a document so, or null."""
    admin = F.coalesce(role == "admin", F.lit(False))
    return (
        F.when((kind == "client") & (visibility != CLIENT), "not_for_kind").when((visibility == PUBLIC) & ~admin, "admin_only")
        .when((visibility == CLIENT) & (kind == "internal") & ~admin, "admin_only").when((visibility == GROUP) & group.isNull(), "group_required")
        .when((visibility == GROUP) & ~F.array_contains(groups, group), "not_a_member")
    )


def owner_for(visibility: Column, user_id: Column) -> Column:
    return F.when(visibility.isin(PRIVATE, CLIENT), user_id)


def group_for(visibility: Column, group: Column) -> Column:
    return F.when(visibility == GROUP, group)


def can_edit(visibility: Column, owner: Column, user_id: Column, role: Column) -> Column:
    """Administrators edit everything, others what is their own."""
    return F.coalesce((role == "admin") | (visibility.isin(PRIVATE, CLIENT) & (owner == user_id)), F.lit(False))


def in_domain(access: Column, domain: str, column: str = "doc_domain") -> Column:
    """``access``, and of one domain; a document without a domain is in none."""
    return access & F.coalesce(F.col(column) == domain, F.lit(False))
