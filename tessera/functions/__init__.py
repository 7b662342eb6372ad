"""Scalar functions of the engine, gathered under one roof; all are Spark column expressions unless noted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.operators.code import entry_point, module_of
from tessera.operators.docs import effective_access, standard_fqn, version_key
from tessera.operators.metadata import artifact_of, fqn_from_object_key, path_kind, path_object, split_fqn, split_handler
from tessera.operators.search import cosine, l2, norm, standard_number, unit_of
from tessera.operators.state import base_tenant, task_of
from tessera.operators.text import kind_ru, mentions, search_tokens, sha1_text, solid
from tessera.sources.help import split_name, version_of  # plain Python
from tessera.sources.metadata_xml import template_type, type_ref


def owner_fqn(source: Column, external_id: Column) -> Column:
    """A document's owner: ``source:external_id``."""
    return F.concat_ws(":", source, external_id)


def top_level(fqn: Column) -> Column:
    """The object that a part belongs to: the first two names."""
    return F.substring_index(fqn, ".", 2)


def in_namespace(tenant: Column, base: str) -> Column:
    """Is the tenant the base or an overlay of it?"""
    return (tenant == base) | tenant.startswith(base + "@task/")


def normalize_slug(c: Column) -> Column:
    """A page's slug: lower case, words joined by hyphens; other characters are dropped at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[\s_/]+", "-"), r"^-+|-+$", "")


def fmt_duration(seconds: Column) -> Column:
    """``1:02:03`` or ``2:03`` of a number of seconds; null of null."""
    s = F.floor(seconds).cast("int")
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", (s / 3600).cast("int"), ((s % 3600) / 60).cast("int"), s % 60)).otherwise(F.format_string("%d:%02d", (s / 60).cast("int"), s % 60))


__all__ = ["artifact_of", "base_tenant", "cosine", "effective_access", "entry_point", "fmt_duration", "fqn_from_object_key", "in_namespace", "kind_ru", "l2", "mentions", "module_of", "norm", "normalize_slug", "owner_fqn", "path_kind", "path_object", "search_tokens", "sha1_text", "solid", "split_fqn", "split_handler", "split_name", "standard_fqn", "standard_number", "task_of", "template_type", "top_level", "type_ref", "unit_of", "version_key", "version_of"]
