"""What the path of a file in a dump says: the object it belongs to, the kind of module, the form.

One rule holds for all: a path is `folder/name/rest`, the folder names the type of its objects, and the rest is `Ext/Kind.bsl`,
or `Forms/Form/...` for a form of the object. Common modules have a single module, common forms are forms without an owner.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .metadata import IRREGULAR, object_type

MODULE, FORM = "CommonModule", "CommonForm"
#: Kinds of modules whose place isn't `Ext/Kind.bsl`.
FORM_MODULE, UNKNOWN = "FormModule", "Unknown"


def relative(path: Column, root: str) -> Column:
    """The part of a file's address below a folder, decoded. Addresses may spell their scheme with one, two or three
    slashes; below an absolute root its first occurrence counts, below another its last."""
    scheme = r"^([A-Za-z][A-Za-z0-9+.-]*:)/+"
    whole = F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), scheme, "$1/")
    start = re.sub(scheme, r"\1/", root).rstrip("/") + "/"
    absolute = start.startswith("/") or ":/" in start
    below = F.regexp_replace(whole, rf"(?s)^.*?\Q{start}\E", "") if absolute else F.substring_index(whole, start, -1)
    return F.regexp_replace(below, "^/+", "")


def _parts(path: Column) -> tuple[Column, Column, Column, Column]:
    """Type, name and form (null for none) of a path below the root, and the rest of it as an array."""
    p = F.split(path, "/")
    rest = F.slice(p, 3, F.greatest(F.size(p) - 2, F.lit(0)))
    type_, name = object_type(p[0]), F.get(p, F.lit(1))
    form = F.when(type_ == FORM, name).when(F.get(rest, F.lit(0)) == "Forms", F.get(rest, F.lit(1)))
    return type_, name, F.regexp_replace(form, r"\.xml$", ""), rest


def module_info(path: Column) -> Column:
    """struct(kind, ref) of a module by its path below the dump's root; ("Unknown", path) if the path says nothing. A form's
    module is one however deep it lies, and its ref has the form's name behind its owner's."""
    type_, name, form, rest = _parts(path)
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.bsl$", "")
    kind = F.when(F.size(rest) == 0, None).when(type_ == MODULE, MODULE).when(form.isNotNull(), FORM_MODULE).when(F.get(rest, F.lit(0)) == "Ext", stem)
    ref = F.concat_ws(".", type_, name, F.when(type_ != FORM, form))
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), ref.alias("ref"))).otherwise(F.struct(F.lit(UNKNOWN).alias("kind"), path.alias("ref")))


def module_name(path: Column) -> Column:
    """The name by which other modules call a module: of a common module its own, else that of the object or file."""
    p = F.split(path, "/")
    ext = F.array_position(p, "Ext").cast("int")
    stem = F.regexp_replace(F.element_at(p, -1), r"\.[^.]*$", "")
    own = F.when(p[0].isin("CommonModules", "CommonForms"), F.get(p, F.lit(1))).when(ext >= 2, F.get(p, ext - 2))
    return F.when(F.size(p) >= 2, F.coalesce(own, stem)).otherwise(stem)


def form_owner(path: Column) -> Column:
    """struct(type, name, form) of a form's file; a common form has no owner's name. Null for other files."""
    type_, name, form, _ = _parts(path)
    return F.when(form.isNotNull(), F.struct(type_.alias("type"), F.when(type_ != FORM, name).alias("name"), form.alias("form")))


def folder_of(type_: Column) -> Column:
    """The folder of a type's objects: the inverse of `metadata.object_type`."""
    out = F.concat(type_, F.lit("s"))
    for folder, kind in IRREGULAR.items():
        out = F.when(type_ == kind, folder).otherwise(out)
    return out


def module_path(ref: Column, kind: Column) -> Column:
    """A pattern (LIKE) of the path of an object's module below the root; null without a name, and for a common module's
    other kinds."""
    type_, name = F.substring_index(ref, ".", 1), F.regexp_extract(ref, r"^[^.]+\.(.+)$", 1)
    own = F.concat(folder_of(type_), F.lit("/"), F.regexp_replace(name, r"([%_\\])", r"\\$1"))
    place = (
        F.when(type_ == MODULE, F.when(kind == MODULE, "/Ext/Module.bsl"))
        .when(kind == FORM_MODULE, F.when(type_ == FORM, "/Ext/Form/Module.bsl").otherwise("/Forms/%/Ext/Form/Module.bsl"))
        .otherwise(F.concat(F.lit("/Ext/"), kind, F.lit(".bsl")))
    )
    return F.when(name != "", F.concat(own, place))
