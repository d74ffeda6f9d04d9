"""Codes that stand for hidden values.

A code is six hex digits. Within a scope the same (category, head, tail, value)
always has the same code, and no two of them share one. Codes are keyed
hashes, so a retried task gives the same code and nobody without the secret can
guess values from codes.

Two forms give that guarantee:

* per document: inside the document's row, no shuffle;
* per shared scope (a batch, or codes continued from an earlier table): the
  distinct values are numbered once, and only the documents that hold a value
  whose code differs from its plain hash are touched again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.functions.fixed_values import CODE_LENGTH
from veilframe.functions.text import each, empty, let
from veilframe.operators.detect import ITEM_COLUMNS, item_table
from veilframe.operators.lookup import lookup
from veilframe.operators.ranking import numbered_rows
from veilframe.session import fits, materialize

KEY = ["category", "head", "tail", "value"]
KEY_TYPE = "struct<category:string,head:int,tail:int,value:string>"
CODES_PER_SCOPE = 16 ** CODE_LENGTH
ATTEMPTS = 64
MARK = chr(1)


def key_text(key: Column) -> Column:
    """A key as one string; equal for equal keys only."""
    return F.concat_ws(MARK, key["category"], key["head"].cast("string"), key["tail"].cast("string"), key["value"])


def _code_of_text(secret: str, scope: Column, text: Column, attempt: Column | int = 0) -> Column:
    n = attempt if isinstance(attempt, Column) else F.lit(attempt)
    return F.substring(F.sha2(F.concat_ws(MARK, F.lit(secret), scope.cast("string"), text, n.cast("string")), 256), 1, CODE_LENGTH)


def hashed_code(secret: str, scope: Column, key: Column, attempt: Column | int = 0) -> Column:
    """The code of a key at an attempt: first digits of a keyed SHA-256."""
    return _code_of_text(secret, scope, key_text(key), attempt)


def key_of(item: Column) -> Column:
    return F.struct(*[item[k].alias(k) for k in KEY])


def _with_code(item: Column, code: Column) -> Column:
    return F.struct(*[item[c].alias(c) for c in ITEM_COLUMNS], code.alias("code"))


def coded_in_row(items: Column, scope: Column, secret: str) -> Column:
    """Items of one document with codes unique inside the document.

    Keys are compared as strings, by hash, so that a document with very many
    items takes time in proportion to their number.
    """
    entry = "struct<key:string,code:string>"

    def plain(i: Column) -> Column:
        return _with_code(i, hashed_code(secret, scope, i))

    def clashes(keys: Column) -> Column:
        """Keys whose hash an earlier key of the document already has, in order."""
        ranked = F.array_sort(F.transform(keys, lambda k, n: F.struct(
            _code_of_text(secret, scope, k).alias("code"), n.alias("n"), k.alias("key"))))
        late = let(ranked, lambda r: F.filter(r, lambda e, n: (n > 0) & (
            e["code"] == F.get(r, n - 1)["code"])))
        return F.array_sort(F.transform(late, lambda e: F.struct(e["n"].alias("n"), e["key"].alias("key"))))

    def resolved(keys: Column, taken: Column) -> Column:
        """A free code for every clashing key, one after the other."""

        def one(acc: Column, e: Column) -> Column:
            tries = F.transform(F.sequence(F.lit(1), F.lit(ATTEMPTS)), lambda a: _code_of_text(secret, scope, e["key"], a))
            free = F.array_except(F.array_except(tries, taken), F.transform(acc, lambda x: x["code"]))
            code = F.coalesce(F.get(free, F.lit(0)), F.raise_error(F.lit("no free code left")).cast("string"))
            return F.array_append(acc, F.struct(e["key"].alias("key"), code.alias("code")))

        return F.aggregate(clashes(keys), empty(entry), one)

    def coded(xs: Column) -> Column:
        done = F.transform(xs, plain)
        keys = F.array_distinct(F.transform(xs, key_text))

        def patched(parts: Column) -> Column:
            book = F.map_from_entries(resolved(parts["keys"], parts["codes"]))
            return let(book, lambda b: F.transform(done, lambda i: _with_code(i, F.coalesce(
                F.try_element_at(b, key_text(i)), i["code"]))))

        measured = let(keys, lambda ks: F.struct(
            ks.alias("keys"), F.transform(ks, lambda k: _code_of_text(secret, scope, k)).alias("codes")))
        return let(measured, lambda m: F.when(
            F.size(F.array_distinct(m["codes"])) == F.size(m["keys"]), done).otherwise(patched(m)))

    return let(items, coded)


def code_per_document(docs: DataFrame, key: str, secret: str, items: str = "items") -> DataFrame:
    """Add ``code`` to the items, unique per document. No shuffle."""
    return docs.withColumn(items, coded_in_row(F.col(items), F.col(key), secret))


# ------------------------------------------------------------ shared scopes
def item_keys(docs: DataFrame, scope: Column, items: str = "items") -> DataFrame:
    """The distinct (scope, category, head, tail, value), combined before the shuffle."""
    found = each(docs.withColumn("scope", scope.cast("string")), items, "scope", name="item")
    return found.select("scope", *[F.col("item")[k].alias(k) for k in KEY]).distinct()


def mapping_keys(mapping: DataFrame) -> DataFrame:
    """Keys and codes of an imported mapping table; the first row of a key wins."""
    return _seeded(mapping).groupBy("scope", *KEY).agg(F.min_by("code", "line_no").alias("code"))


def mapping_conflicts(mapping: DataFrame) -> DataFrame:
    """Values an imported table lists under more than one code: the code kept and the code ignored."""
    kept = mapping_keys(mapping).withColumnRenamed("code", "kept_code")
    return lookup(_seeded(mapping), kept, ["scope", *KEY]).where(F.col("code") != F.col("kept_code")).select(
        "scope", "category", "value", "kept_code", F.col("code").alias("ignored_code"))


def _seeded(mapping: DataFrame) -> DataFrame:
    prefix, suffix = (F.coalesce(F.col(c), F.lit("")) for c in ("kept_prefix", "kept_suffix"))
    return mapping.select(
        "scope", "line_no", "code", "category", F.length(prefix).alias("head"), F.length(suffix).alias("tail"),
        F.concat(prefix, F.col("original"), suffix).alias("value"))


def allocate(keys: DataFrame, secret: str, imported: DataFrame | None = None) -> DataFrame:
    """Give every key of ``keys`` (scope + KEY, distinct) a code unique in its scope.

    Keys of ``imported`` (a mapping table) keep their codes, and no new key gets
    a code of that table. Each round hashes the open keys once more; of several
    keys with one hash the first wins, the rest try again. All but a few keys
    are settled in the first round; those that lose every draw, in a scope that
    is nearly full, get the codes that are left.
    """
    ids = ["scope", *KEY]
    columns = [*ids, "code"]
    open_keys, taken, settled = materialize(keys.select(*ids), "keys"), None, []
    if imported is not None:
        known = materialize(mapping_keys(imported).select(*columns), "known-codes")
        taken = materialize(imported.select("scope", "code").distinct(), "taken-codes")
        seen = materialize(lookup(open_keys, known, ids), "seen-keys")
        settled.append(seen.where("code is not null").select(*columns))
        open_keys = seen.where("code is null").select(*ids)

    wanted = open_keys.select("scope") if taken is None else open_keys.select("scope").unionByName(taken.select("scope"))
    if not wanted.groupBy("scope").count().where(F.col("count") > CODES_PER_SCOPE).isEmpty():
        raise ValueError(f"a scope needs more than {CODES_PER_SCOPE} codes")

    for attempt in range(ATTEMPTS):
        tried = open_keys.withColumn("code", hashed_code(secret, F.col("scope"), F.struct(*KEY), attempt))
        if taken is not None:
            # After the first round few keys are open: only their codes are looked for among those taken.
            clash = taken
            if fits(open_keys):
                clash = taken.join(F.broadcast(tried.select("scope", "code").distinct()), ["scope", "code"], "left_semi")
            tried = tried.join(clash.distinct().withColumn("_used", F.lit(True)), ["scope", "code"], "left")
        else:
            tried = tried.withColumn("_used", F.lit(None).cast("boolean"))
        order = Window.partitionBy("scope", "code").orderBy(*KEY)
        ranked = tried.withColumn("_rn", F.row_number().over(order)).withColumn(
            "won", F.col("_used").isNull() & (F.col("_rn") == 1))
        round_ = materialize(ranked.select(*columns, "won"), f"codes-{attempt}")
        winners = round_.where("won").select(*columns)
        settled.append(winners)
        open_keys = round_.where(~F.col("won")).select(*ids)
        if open_keys.isEmpty():
            break
        used = winners.select("scope", "code")
        taken = used if taken is None else taken.unionByName(used)
    else:
        settled.append(materialize(_from_free_codes(open_keys, taken), "codes-rest"))
    book = settled[0]
    for part in settled[1:]:
        book = book.unionByName(part)
    return book


def _from_free_codes(open_keys: DataFrame, taken: DataFrame) -> DataFrame:
    """Codes for keys that lost every draw, in a scope that is nearly full: the scope's free codes in order, by rank."""
    ranked = numbered_rows(open_keys, ["scope"], KEY, "_n")
    wanted = materialize(ranked.groupBy("scope").agg(F.max("_n").alias("_most")), "scopes-with-rest")
    side = 16 ** (CODE_LENGTH // 2)
    high, low = F.sequence(F.lit(0), F.lit(CODES_PER_SCOPE // side - 1)), F.sequence(F.lit(0), F.lit(side - 1))
    every = wanted.select("scope", F.explode(high).alias("_h")).select("scope", "_h", F.explode(low).alias("_l")).select(
        "scope", F.lower(F.lpad(F.hex(F.col("_h") * side + F.col("_l")), CODE_LENGTH, "0")).alias("code"))
    free = numbered_rows(every.join(taken.distinct(), ["scope", "code"], "left_anti"), ["scope"], ["code"], "_n")
    needed = free.join(wanted, "scope").where("_n <= _most").select("scope", "_n", "code")
    return ranked.join(needed, ["scope", "_n"]).select("scope", *KEY, "code")


def code_shared(docs: DataFrame, key: str, secret: str, scope: Column | None = None,
                imported: DataFrame | None = None, items: str = "items") -> tuple[DataFrame, DataFrame]:
    """Codes shared by all documents of a scope; gives (documents, code book).

    Documents take the plain hash in their own row. Values whose code differs
    from it (a lost clash, or a code continued from ``imported``) are the only
    ones that are joined, and only their documents get a patch. Pass documents
    with materialized items when detection is expensive.
    """
    scope = F.lit("shared") if scope is None else scope
    book = materialize(allocate(item_keys(docs, scope, items), secret, imported), "code-book")
    other = book.where(F.col("code") != hashed_code(secret, F.col("scope"), F.struct(*KEY)))
    plain = docs.withColumn(items, F.transform(items, lambda i: _with_code(
        i, hashed_code(secret, scope, key_of(i)))))
    if other.isEmpty():
        return plain, book

    used = each(docs.withColumn("scope", scope.cast("string")), items, key, "scope", name="item").select(
        key, "scope", *[F.col("item")[k].alias(k) for k in KEY]).distinct()
    patches = lookup(used, other, ["scope", *KEY]).where("code is not null").groupBy(key).agg(
        F.collect_list(F.struct(F.struct(*KEY).alias("key"), F.col("code").alias("code"))).alias("_patch"))

    def patched(xs: Column, patch: Column) -> Column:
        return F.transform(xs, lambda i: _with_code(i, F.coalesce(
            F.get(F.filter(patch, lambda e: e["key"] == key_of(i)), F.lit(0))["code"], i["code"])))

    # Few patches are broadcast, and the texts stay where they are.
    patches = materialize(patches, "patches")
    joined = plain.join(F.broadcast(patches) if fits(patches) else patches, key, "left")
    return joined.withColumn(items, F.when(F.col("_patch").isNull(), F.col(items)).otherwise(
        patched(F.col(items), F.col("_patch")))).drop("_patch"), book
