"""Commands of all kinds in one table, run in their order: what single commands of the Desk do one after another.

A command sees what the earlier ones did, so those that name the same copy, resource or loan, or copies of one resource,
must run in one order; all others needn't. So the copies, resources and loans that commands name are linked (a resource
with its copies, before and after changes of it; a copy with its loan; a resource with the box of its copies, where that
box is changed by a command too), and every linked group is folded by one ordered aggregate over its commands, whose
state is the group's loans and resources. What no command reaches is neither gathered nor changed.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import dates as D
from shelfspark.functions.copies import k2_copies, k3_loan, k4_copies
from shelfspark.functions.text import text
from shelfspark.operators import boxes
from shelfspark.operators.ids import identified
from shelfspark.operators.linked import labelled
from shelfspark.plans import desk
from shelfspark.plans.commands import SAYS, said
from shelfspark.schemas import LOAN_DAYS, LOANS, MEDIA, TABLES
from shelfspark.sources.store import scratch

#: What commands are called, by what their target is: a barcode, a loan's id, a resource's id, a row to save (blank to create it).
BARCODE = ["checkout", "checkout_by_barcode", "return_by_barcode", "extend_by_barcode"]
LOAN = ["return", "extend"]
RESOURCE = ["checkout_by_resource", "delete_media", "save_media"]
MEMBER = ["save_borrower"]
CHECKOUT = ["checkout", "checkout_by_barcode", "checkout_by_resource"]

_HELD = "array<struct<barcode:string,boxBarcode:string,boxTitle:string,live:boolean>>"
_DONE = "array<struct<seq:bigint,op:string,target:string,error:string,barcode:string,dueDate:string,actions:array<string>>>"


class Mixed(NamedTuple):
    borrowers: DataFrame
    media: DataFrame
    loans: DataFrame
    #: seq, op, target, success, error, barcode (of a checkout), dueDate (of an extension)
    outcomes: DataFrame
    #: seq, nth, action
    audit: DataFrame


# ---- one step of the fold ------------------------------------------------------------------------------------------


def _first(rows: Column, test) -> Column:
    return F.get(F.filter(rows, test), F.lit(0))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _cases(of: Column, *cases: tuple[list[str], Column], otherwise: Column | None = None) -> Column:
    out = F
    for names, value in cases:
        out = out.when(of.isin(names), value)
    return out if otherwise is None else out.otherwise(otherwise)


def _errors(*cases: tuple[Column, Column]) -> Column:
    out = F
    for test, message in cases:
        out = out.when(test, message)
    return out


def _loan(**cells: Column) -> Column:
    return F.struct(*[cells[c].alias(c) for c in LOANS.names])


def _step(s: Column, o: Column, as_of: D.Day) -> Column:
    """The state after a command: its loans and resources, and what the command came to."""
    is_ = lambda *names: o["op"].isin(list(names))
    scanned = is_("checkout_by_barcode", "return_by_barcode", "extend_by_barcode")
    resource = F.when(scanned, _first(s["media"], lambda m: F.exists(m["copies"], lambda c: F.lower(c) == o["key"]))).otherwise(_first(s["media"], lambda m: m["id"] == o["target"]))
    loan = F.when(is_(*LOAN), _first(s["loans"], lambda x: (x["id"] == o["target"]) & (o["target"] != ""))).otherwise(_first(s["loans"], lambda x: F.lower(x["barcode"]) == o["key"]))

    def with_copy(v: Column) -> Column:
        r, loan = v["r"], v["l"]
        free = F.filter(r["copies"], lambda c: ~F.exists(s["loans"], lambda x: k3_loan(x["barcode"]) == F.lower(c)))
        copy = _cases(
            o["op"], (["checkout"], o["target"]), (["checkout_by_barcode"], _first(r["copies"], lambda c: F.lower(c) == o["key"])),
            (["checkout_by_resource"], F.when(F.size(free) == 1, F.get(free, F.lit(0)))), (["return_by_barcode"], loan["barcode"]),
        )
        own = lambda test: F.filter(s["loans"], lambda x: F.array_contains(r["copies"], x["barcode"]) & test(x["dueDate"], as_of))
        late = F.when(is_("delete_media"), own(D.overdue))
        current = F.when(is_("delete_media"), F.size(own(D.not_yet_due)))
        return _let(F.struct(r.alias("r"), loan.alias("l"), copy.alias("copy"), F.size(free).alias("n"), late.alias("late"), current.alias("current")), with_box)

    def with_box(v: Column) -> Column:
        guarded = is_("checkout_by_barcode", "checkout_by_resource", "return_by_barcode")
        box = F.when(guarded, _first(v["r"]["held"], lambda h: h["barcode"] == v["copy"]))
        return _let(F.struct(v.alias("v"), box.alias("box"), F.exists(s["loans"], lambda x: x["barcode"] == v["copy"]).alias("taken")), judged)

    def judged(w: Column) -> Column:
        v, box = w["v"], w["box"]
        r, loan = v["r"], v["l"]
        inside = _first(s["media"], lambda m: F.array_contains(m["copies"], box["boxBarcode"]))["title"]
        box_title = F.when(box["live"], F.coalesce(F.nullif(inside, F.lit("")), box["boxBarcode"])).otherwise(box["boxTitle"])
        boxed = lambda what, x, barcode: (box.isNotNull(), said(what, title=x["title"], barcode=barcode, boxTitle=box_title, boxBarcode=box["boxBarcode"]))
        taken, one = (w["taken"], F.lit(SAYS["taken"])), v["current"] == 1
        no_resource, no_loan = (r.isNull(), F.lit(SAYS["no resource"])), (loan.isNull(), F.lit(SAYS["no loan"]))
        unknown = said("unknown", barcode=o["target"])
        current = said("current", title=r["title"], n=v["current"], copies=F.when(one, "copy is").otherwise("copies are"), it=F.when(one, "it").otherwise("them"))
        error = _cases(
            o["op"],
            (["checkout"], _errors(taken)),
            (["checkout_by_barcode"], _errors((r.isNull(), unknown), boxed("boxed out", r, v["copy"]), taken)),
            (["checkout_by_resource"], _errors(no_resource, (v["n"] == 0, said("none free", title=r["title"])), (v["n"] > 1, said("many free", n=v["n"], title=r["title"])), boxed("boxed out", r, v["copy"]), taken)),
            (LOAN, _errors(no_loan)),
            (["return_by_barcode"], _errors((loan.isNull(), said("not loaned", barcode=o["target"])), boxed("boxed in", loan, loan["barcode"]))),
            (["extend_by_barcode"], _errors((~F.exists(s["media"], lambda m: F.array_contains(m["known"], o["key"])), unknown), (loan.isNull(), said("not out", barcode=o["target"])))),
            (["delete_media"], _errors(no_resource, (v["current"] > 0, current))),
            (["save_media"], _errors((~o["create"] & r.isNull(), F.concat(F.lit("Media with ID "), o["target"], F.lit(" not found"))))),
        )
        due = F.coalesce(D.later(loan["dueDate"], o["days"]), loan["dueDate"])
        return _let(F.struct(v.alias("v"), error.alias("error"), due.alias("due")), after)

    def after(w: Column) -> Column:
        v, ok = w["v"], w["error"].isNull()
        r, loan = v["r"], v["l"]
        this = lambda x: (x["id"] == loan["id"]) & (x["barcode"] == loan["barcode"])
        day = D.day(as_of)
        title = F.when(is_("checkout"), o["cells"]["title"]).otherwise(r["title"])
        new = _loan(id=o["new"], barcode=v["copy"], title=text(title), checkoutDate=D.show(day), dueDate=D.show(F.date_add(day, o["days"])), borrowerName=o["borrowerName"], borrowerId=o["borrowerId"])
        more = lambda x: _loan(**{c: w["due"] if c == "dueDate" else x[c] for c in LOANS.names})
        loans = _cases(
            o["op"],
            (CHECKOUT, F.sort_array(F.concat(s["loans"], F.array(new)))),
            (["return", "return_by_barcode"], F.filter(s["loans"], lambda x: ~this(x))),
            (["extend", "extend_by_barcode"], F.transform(s["loans"], lambda x: F.when(this(x), more(x)).otherwise(x))),
            (["delete_media"], F.filter(s["loans"], lambda x: ~F.array_contains(v["late"], x))),
            otherwise=s["loans"],
        )
        cells = lambda m: F.struct(
            *[(o["new"] if c == "id" else text(o["cells"][c])).alias(c) if m is None else (m[c] if c == "id" else F.coalesce(o["cells"][c], m[c])).alias(c) for c in MEDIA.names],
            *[(F.coalesce(o[c], F.array() if m is None else m[c]).alias(c)) for c in ("copies", "known", "held")],
        )
        media = _cases(
            o["op"],
            (["delete_media"], F.filter(s["media"], lambda m: m["id"] != o["target"])),
            (["save_media"], F.when(o["create"], F.sort_array(F.concat(s["media"], F.array(cells(None))))).otherwise(F.transform(s["media"], lambda m: F.when(m["id"] == o["target"], cells(m)).otherwise(m)))),
            otherwise=s["media"],
        )
        days = {"days": o["days"]}
        out = {"name": o["borrowerName"], "borrower": o["borrowerId"]} | days
        data = F.to_json(F.struct(F.lit(True).alias("success"), loan.alias("data")))
        failed = F.to_json(F.struct(F.lit(False).alias("success"), w["error"].alias("error")))
        when_ok = lambda *actions: F.when(ok, F.array(*actions)).otherwise(F.array().cast("array<string>"))
        lost = F.transform(v["late"], lambda x: said("lost", title=r["title"], barcode=x["barcode"], loan=x["id"], name=x["borrowerName"]))
        saved = F.when(o["create"], said("created", kind=F.lit("media"), name=text(o["cells"]["title"]))).otherwise(said("updated", kind=F.lit("media"), name=text(o["cells"]["title"]), id=o["target"]))
        actions = _cases(
            o["op"],
            (["checkout"], F.array(said("out", title=text(title), barcode=o["target"], **out))),
            (["checkout_by_barcode"], when_ok(said("out", title=title, barcode=v["copy"], **out))),
            (["checkout_by_resource"], when_ok(said("out by name", title=title, barcode=v["copy"], **out))),
            (["return"], F.array(said("in by id", outcome=F.when(ok, data).otherwise(failed)))),
            (["return_by_barcode"], when_ok(said("in", title=loan["title"], barcode=loan["barcode"], name=loan["borrowerName"]))),
            (["extend"], F.array(said("more by id", loan=o["target"], **days))),
            (["extend_by_barcode"], when_ok(said("more", title=loan["title"], barcode=loan["barcode"], **days))),
            (["delete_media"], F.when(ok, F.concat(lost, F.array(said("deleted", title=r["title"], resource=o["target"])))).otherwise(F.array().cast("array<string>"))),
            (["save_media"], F.array(saved)),
        )
        done = F.struct(
            o["seq"].alias("seq"), o["op"].alias("op"), o["target"].alias("target"), w["error"].alias("error"),
            F.when(ok & is_(*CHECKOUT), v["copy"]).alias("barcode"), F.when(ok & is_("extend", "extend_by_barcode"), w["due"]).alias("dueDate"), actions.alias("actions"),
        )
        return F.struct(F.when(ok, loans).otherwise(s["loans"]).alias("loans"), F.when(ok, media).otherwise(s["media"]).alias("media"), F.concat(s["done"], F.array(done)).alias("done"))

    return _let(F.struct(resource.alias("r"), loan.alias("l")), with_copy)


# ---- groups --------------------------------------------------------------------------------------------------------


def _node(kind: str, value: Column) -> Column:
    """A node of the links; null for a blank value."""
    return F.concat(F.lit(f"{kind}:"), F.nullif(value, F.lit("")))


def _copies_of(m: DataFrame, who: Column) -> DataFrame:
    """(a, b): a resource's node and one of its copies'."""
    return m.select(_node("r", who).alias("a"), F.explode(k4_copies("barcodes")).alias("copy")).select("a", _node("c", F.col("copy")).alias("b"))


def _written(df: DataFrame, what: str) -> DataFrame:
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _held(m: DataFrame, catalogue: DataFrame, live: DataFrame) -> DataFrame:
    """id and held: box entries of m's resources, live where the box is changed by a command."""
    e = boxes.containing(m, catalogue).withColumn("key", _node("c", k3_loan("boxBarcode"))).join(live.select(F.col("node").alias("key"), F.lit(True).alias("live")), "key", "left")
    return e.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("barcode", "boxBarcode", "boxTitle", F.coalesce("live", F.lit(False)).alias("live")))).alias("held"))


def run(borrowers: DataFrame, media: DataFrame, loans: DataFrame, todo: DataFrame, as_of: D.Day = None) -> Mixed:
    """todo: seq (long, no two alike), op, target, days (null: the usual ones) and cells (map of text): of a checkout
    borrowerId, borrowerName and, where the barcode is given as it is, title; of what is saved the cells that change.

    Rows of another op are ignored. Ids of members, resources and loans are taken to be unique; a blank one names nothing.
    New rows get ids that their table doesn't have (operators.ids), in the order of seq. A group's commands and rows meet
    in one row, however many commands there are in all; a copy, loan or resource with very many commands makes a large one.
    """
    t = todo.select(F.col("seq").cast("long").alias("seq"), "op", text("target").alias("target"), F.coalesce(F.col("days").cast("int"), F.lit(LOAN_DAYS)).alias("days"), "cells")
    t = _written(t, "commands")
    members = t.where(F.col("op").isin(MEMBER)).select("seq", F.col("target").alias("id"), *[F.col("cells")[c].alias(c) for c in TABLES["Borrowers"].names if c != "id"])
    saved = desk.saves(borrowers, "Borrowers", members) if members.limit(1).count() else None
    t = t.where(F.col("op").isin(BARCODE + LOAN + RESOURCE))
    creates = F.col("op").isin("save_media") & (F.col("target") == "")
    ids = identified(t.where(F.col("op").isin(CHECKOUT)).select("seq"), "seq", loans.select("id"), "L").unionByName(identified(t.where(creates).select("seq"), "seq", media.select("id"), "M"))
    t = t.join(ids.withColumnRenamed("id", "new"), "seq", "left").withColumn("create", creates)
    node = F.when(F.col("op").isin(BARCODE), _node("c", k3_loan("target"))).when(F.col("op").isin(LOAN), _node("l", F.col("target"))).otherwise(_node("r", F.coalesce(F.when(F.col("create"), F.col("new")), F.col("target"))))
    t = _written(t.withColumn("node", F.coalesce(node, F.concat(F.lit("s:"), F.col("seq").cast("string")))), "commands")

    # links: resources and copies, as they are and as they will be; copies and loans
    changes = t.where(F.col("op") == "save_media").withColumn("barcodes", F.col("cells")["barcodes"]).where("barcodes is not null")
    will_be = _copies_of(changes, F.coalesce("new", "target"))
    are = _copies_of(media, F.col("id"))
    of_loans = loans.select(_node("l", F.col("id")).alias("a"), _node("c", k3_loan("barcode")).alias("b"))
    seeds = t.select("node").distinct()
    labels = labelled(seeds, are.unionByName(will_be).unionByName(of_loans))
    # boxes that commands change are linked with what lies in them, group by group
    changed = t.where(F.col("op").isin("delete_media", "save_media")).select(F.col("node").alias("a")).distinct()
    live = _written(are.unionByName(will_be).join(changed, "a", "left_semi").select(F.col("b").alias("node")).where("node is not null").distinct(), "live")
    own = media.withColumn("node", _node("r", F.col("id"))).join(labels, "node")
    boxed = t.where(F.col("op") == "save_media").select(F.col("seq").cast("string").alias("id"), F.col("cells")["resourceBox"].alias("resourceBox"), "node")
    held, will_hold = _written(_held(own, media, live), "held"), _written(_held(boxed, media, live), "held")
    inside = own.select("id", "label").join(held, "id").unionByName(boxed.join(labels, "node").select("id", "label").join(will_hold, "id"))
    inside = inside.select("label", F.explode("held").alias("h")).where("h.live").select("label", _node("c", k3_loan("h.boxBarcode")).alias("node"))
    between = inside.join(labels.withColumnRenamed("label", "of"), "node").select(F.col("label").alias("a"), F.col("of").alias("b"))
    groups = labelled(labels.select(F.col("label").alias("node")).distinct(), between).select(F.col("node").alias("label"), F.col("label").alias("group"))
    placed = _written(labels.join(groups, "label").select("node", "group"), "groups")

    # each group's commands, resources and loans
    cells = F.struct(*[F.col("cells")[c].alias(c) for c in MEDIA.names if c != "id"])
    given = lambda c, name: F.when((F.col("op") == "save_media") & F.col("cells")["barcodes"].isNotNull(), c(F.col("cells")["barcodes"])).alias(name)
    with_box = F.when((F.col("op") == "save_media") & F.col("cells")["resourceBox"].isNotNull(), F.coalesce("held", F.array().cast(_HELD))).alias("held")
    o = t.join(will_hold.withColumn("seq", F.col("id").cast("long")).drop("id"), "seq", "left").join(placed, "node")
    ops = o.groupBy("group").agg(
        F.sort_array(F.collect_list(F.struct(
            "seq", "op", "target", F.lower("target").alias("key"), "days", text(F.col("cells")["borrowerId"]).alias("borrowerId"), text(F.col("cells")["borrowerName"]).alias("borrowerName"),
            "new", "create", cells.alias("cells"), given(k2_copies, "copies"), given(k4_copies, "known"), with_box,
        ))).alias("ops")
    )
    m = media.withColumn("node", _node("r", F.col("id"))).join(placed, "node", "left")
    row = F.struct(*[text(c).alias(c) for c in MEDIA.names], k2_copies("barcodes").alias("copies"), k4_copies("barcodes").alias("known"), F.coalesce("held", F.array().cast(_HELD)).alias("held"))
    own_media = m.where("group is not null").join(held, "id", "left").groupBy("group").agg(F.sort_array(F.collect_list(row)).alias("media"))
    by = lambda kind: placed.select(F.col("node").alias(f"_{kind}"), F.col("group").alias(f"_{kind}_group"))
    n = loans.withColumns({"_l": _node("l", F.col("id")), "_c": _node("c", k3_loan("barcode"))}).join(by("l"), "_l", "left").join(by("c"), "_c", "left").withColumn("group", F.coalesce("_l_group", "_c_group"))
    own_loans = n.where("group is not null").groupBy("group").agg(F.sort_array(F.collect_list(F.struct(*[text(c).alias(c) for c in LOANS.names]))).alias("loans"))
    g = ops.join(own_media, "group", "left").join(own_loans, "group", "left")
    kinds = {f.name: f.dataType for f in g.schema.fields}
    state = F.struct(F.coalesce("loans", F.array().cast(kinds["loans"])).alias("loans"), F.coalesce("media", F.array().cast(kinds["media"])).alias("media"), F.array().cast(_DONE).alias("done"))
    out = _written(g.select(F.aggregate("ops", state, lambda s, o: _step(s, o, as_of)).alias("s")).select("s.*"), "folded")

    after = lambda old, name, names: old.where("group is null").select(*names).unionByName(out.select(F.explode(name).alias("x")).select("x.*").select(*names))
    each = out.select(F.explode("done").alias("d")).select("d.*")
    outcomes = each.select("seq", "op", "target", F.col("error").isNull().alias("success"), "error", "barcode", "dueDate")
    audit = each.select("seq", F.posexplode("actions").alias("nth", "action"))
    if saved:
        own = saved.outcomes.select("seq", F.lit(MEMBER[0]).alias("op"), F.col("id").alias("target"), "success", "error", *[F.lit(None).cast("string").alias(c) for c in ("barcode", "dueDate")])
        outcomes, audit = outcomes.unionByName(own), audit.unionByName(saved.audit.select("seq", F.lit(0).alias("nth"), "action"))
    return Mixed(saved.state if saved else borrowers, after(m, "media", MEDIA.names), after(n, "loans", LOANS.names), outcomes, audit)
