"""The node frame: one row for each node of a tree, and the column expressions that define its derived values.

Columns: path, parent, name, depth, type, hash, mtime, nbytes, nnodes, link_target, err_msg; (path) is unique.
Types: D directory, F file, L link whose content lies in the tree, B link that is broken or leads outside, E scan error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (("path", T.StringType()), ("parent", T.StringType()), ("name", T.StringType()), ("depth", T.IntegerType()), ("type", T.StringType()), ("hash", T.StringType()), ("mtime", T.LongType()), ("nbytes", T.LongType()), ("nnodes", T.LongType()), ("link_target", T.StringType()), ("err_msg", T.StringType()))]
)
NODE_COLUMNS = NODE_SCHEMA.names

#: The order of types in sorted listings, the hash text of an error, and the digest's length.
TYPE_ORDER = "DFLBE"
ERROR_HASH = "ERROR"
DIGEST_LENGTH = 20
#: Own size of a directory that has none recorded.
DIR_BYTES = 4096


def digest(content: Column, full: bool = False) -> Column:
    """SHA-256 of a string or binary column, in hexadecimal, base64 of that, cut to 20 characters (60 bits).

    n different contents collide with a chance of about n**2 / 2**61; full=True keeps all 64 hexadecimal digits.
    """
    hexadecimal = F.sha2(content.cast("binary"), 256)
    return hexadecimal if full else compress(hexadecimal)


def compress(hexadecimal: Column) -> Column:
    """The short form of a digest given in hexadecimal."""
    return F.substring(F.base64(hexadecimal.cast("binary")), 1, DIGEST_LENGTH)


def children_digest(hashes: Column, full: bool = False) -> Column:
    """Digest of a directory from an array of its children's hashes: sorted bytewise, repetitions kept, a line each.

    Names don't enter. An empty array gives the digest of nothing, as an empty file has.
    """
    lines = F.array_join(F.array_sort(hashes), "\n")
    return digest(F.when(F.size(hashes) > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), full)


def type_rank(kind: Column) -> Column:
    return F.instr(F.lit(TYPE_ORDER), kind)


def parent_of(path: Column) -> Column:
    """Path without its last component; null for a root."""
    cut = F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1
    return F.when(cut > 0, F.substring(path, F.lit(1), cut))


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def depth_of(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def below_root(path: Column) -> Column:
    """Path without the root's name; '' for a root."""
    at = F.instr(path, "/")
    return F.when(at > 0, path.substr(at + 1, F.length(path))).otherwise(F.lit(""))


# Names may hold bytes that are not UTF-8. Regexes and split() would replace them; what is used here works on bytes.


def components(path: Column) -> Column:
    """Path as an array, which sorts component by component (plain strings sort '-' before '/')."""
    return F.transform(F.sequence(F.lit(1), depth_of(path) + 1), lambda k: F.split_part(path, F.lit("/"), k))


def ancestors(path: Column, own: bool = False) -> Column:
    """Array of the paths of all ancestors from the root down, with the node's own path at the end if asked for."""
    count = depth_of(path) + 1 if own else depth_of(path)
    made = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda k: F.call_function("substring_index", path, F.lit("/"), k))
    return F.when(count > 0, made).otherwise(F.array().cast("array<string>"))


def annex_digest(name: Column, full: bool = False) -> Column:
    """Digest that a content-addressed file name states, null for other names: SHA256E-<field>--<64 hex digits>[.ext]."""
    stated = F.regexp_extract(name, r"^SHA256E-[a-z0-9]{2,}--([0-9a-f]{64})(\.[\s\S]*)?$", 1)
    return F.when(stated != "", stated if full else compress(stated))


def is_annex_target(target: Column) -> Column:
    """Whether a link's target points into an annex's object store."""
    return F.coalesce(target.contains(".git/annex/objects/") & F.substring_index(target, "/", -1).startswith("SHA256E-"), F.lit(False))


def is_plain_link(target: Column) -> Column:
    """Whether a node is a link that points anywhere else."""
    return target.isNotNull() & ~is_annex_target(target)


def sanitize_message(message: Column) -> Column:
    """Error text with letters, digits, white space and / : ( ) [ ] . _ - only."""
    return F.regexp_replace(message, r"[^\p{L}\p{N}\s/:()\[\]._-]", "")


def simplify_message(message: Column) -> Column:
    """Sanitized text after its first ': ', all of it if there is none."""
    clean = sanitize_message(message)
    at = F.instr(clean, ": ")
    return F.when(at > 0, clean.substr(at + 2, F.length(clean))).otherwise(clean)


def valid_name(name: Column) -> Column:
    """A name is not empty, not '.' or '..', and holds neither '/' nor NUL."""
    return (F.length(name) > 0) & ~name.isin(".", "..") & (F.instr(name, "/") == 0) & (F.instr(name, "\0") == 0)


def errors(nodes: DataFrame) -> DataFrame:
    return nodes.where("type = 'E'")
