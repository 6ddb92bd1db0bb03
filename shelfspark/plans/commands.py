"""Circulation commands as transformations of a state: (state, commands) to (state, outcomes, audit records).

``circulate`` folds any number of commands, in their order, over all barcodes at once. ``Desk`` runs single commands
with the guards and messages of the circulation desk. Nothing is written until a state is saved (sources.store).
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from shelfspark.functions import dates as D
from shelfspark.functions.copies import exploded, k3_loan
from shelfspark.functions.text import cut, same_id
from shelfspark.operators import availability as A
from shelfspark.operators import boxes
from shelfspark.operators import rows as R
from shelfspark.operators.ids import numbered_id
from shelfspark.plans.queries import in_catalogue, loan_of, owner_of
from shelfspark.schemas import LOAN_DAYS, LOANS, TABLES
from shelfspark.sources.tables import by_id

#: What the desk says.
SAYS = {
    "taken": "Media item is not available for checkout",
    "unknown": "Barcode {barcode} not found in catalog",
    "boxed out": '"{title}" ({barcode}) is inside box "{boxTitle}" ({boxBarcode}). Check out the box instead.',
    "boxed in": '"{title}" ({barcode}) is inside box "{boxTitle}" ({boxBarcode}). Return the box instead.',
    "no resource": "Resource not found",
    "no loan": "Loan not found",
    "none free": 'No copies of "{title}" are available — every copy is already checked out.',
    "many free": "There are {n} copies of \"{title}\" on the shelf, so we can't tell which one was taken. Please find the physical item and check it out by scanning its barcode.",
    "not loaned": "No active loan found for barcode {barcode}",
    "not out": "Barcode {barcode} is not currently checked out",
    "current": 'Cannot delete "{title}" — {n} {copies} currently on loan and not yet due. Return {it} first.',
}

#: What the audit log says.
LOGS = {
    "out": 'checked out "{title}" (barcode={barcode}) to {name} (borrower={borrower}) for {days} days',
    "out by name": 'checked out by name "{title}" (barcode={barcode}) to {name} (borrower={borrower}) for {days} days',
    "in": 'returned "{title}" (barcode={barcode}) from {name}',
    "in by id": "returned loan: {outcome}",
    "more": 'extended "{title}" (barcode={barcode}) by {days} days',
    "more by id": "extended loan: {loan} by {days} days",
    "lost": 'deleted overdue loan during resource deletion: "{title}" (barcode={barcode}, loan={loan}, borrower={name})',
    "deleted": "deleted media: {title} (ID: {resource})",
    "created": "created {kind}: {name}",
    "updated": "updated {kind}: {name} (ID: {id})",
    "opened": "opened {what}",
}


class Circulated(NamedTuple):
    loans: DataFrame
    outcomes: DataFrame
    audit: DataFrame
    #: The loans that commands reached, as they were and as they are.
    before: DataFrame
    after: DataFrame


def circulate(loans: DataFrame, todo: DataFrame, as_of: D.Day = None, ordinal: str = "title") -> Circulated:
    """Fold checkouts, returns and extensions over the loans.

    todo: seq (order; a running number for the library's life, from which new loans' ids are made: no two below 26 * 10**9
    make the same, operators.ids), op (checkout, return or extend), barcode as the catalogue spells it; of a checkout also title,
    borrowerId and borrowerName; days is optional. Commands on one barcode see what the earlier ones did. A barcode has
    one loan at most: of several checkouts the first wins. Rows of equal id and barcode are one loan, of which the first by
    ordinal, a column of loans, counts; loans of other barcodes stay, whatever their ids.
    """
    have = set(todo.columns)
    cell = lambda c, kind, default: (F.coalesce(F.col(c).cast(kind), F.lit(default)) if c in have else F.lit(default).cast(kind)).alias(c)
    op = F.struct(
        F.col("seq").cast("long").alias("seq"), "op", cell("title", "string", ""), cell("borrowerId", "string", ""), cell("borrowerName", "string", ""), cell("days", "int", LOAN_DAYS),
        F.when(F.col("op") == "checkout", numbered_id("L", "seq")).alias("new"),
    )
    per = todo.groupBy("barcode").agg(F.sort_array(F.collect_list(op)).alias("ops"))
    names = LOANS.names
    now = loans.groupBy("barcode").agg(F.min(F.struct("id", F.col(ordinal).alias("nth"), F.struct(*names).alias("loan")))["loan"].alias("loan"))
    j = per.join(now, "barcode", "left").withColumn("day", D.day(as_of))
    loan_type = "struct<" + ",".join(f"{n}:string" for n in names) + ">"
    fmt = "MMMM d, yyyy"
    due = "coalesce(try_to_date(s.loan.dueDate, 'MMMM d, yyyy'), try_to_date(s.loan.dueDate, 'yyyy-MM-dd'))"
    checked = f"named_struct('id', o.new, 'barcode', barcode, 'title', o.title, 'checkoutDate', date_format(day, '{fmt}'), 'dueDate', date_format(date_add(day, o.days), '{fmt}'), 'borrowerName', o.borrowerName, 'borrowerId', o.borrowerId)"
    more = f"coalesce(date_format(date_add({due}, o.days), '{fmt}'), s.loan.dueDate)"
    extended = f"named_struct('id', s.loan.id, 'barcode', s.loan.barcode, 'title', s.loan.title, 'checkoutDate', s.loan.checkoutDate, 'dueDate', {more}, 'borrowerName', s.loan.borrowerName, 'borrowerId', s.loan.borrowerId)"
    done = "array<struct<seq:bigint,op:string,error:string,action:string,dueDate:string>>"

    def result(error: str, action: str = "cast(null as string)", after: str = "cast(null as string)") -> str:
        return f"concat(s.done, array(named_struct('seq', o.seq, 'op', o.op, 'error', {error}, 'action', {action}, 'dueDate', {after})))"

    ok, taken, none = "cast(null as string)", _spelled("taken"), _spelled("not loaned", barcode="barcode")
    says_out = _spelled("out", title="o.title", barcode="barcode", name="o.borrowerName", borrower="o.borrowerId", days="o.days")
    says_in = _spelled("in", title="s.loan.title", barcode="barcode", name="s.loan.borrowerName")
    says_more = _spelled("more", title="s.loan.title", barcode="barcode", days="o.days")
    step = f"""case
      when o.op = 'checkout' and s.loan is null then named_struct('loan', cast({checked} as {loan_type}), 'done', {result(ok, says_out)})
      when o.op = 'checkout' then named_struct('loan', s.loan, 'done', {result(taken)})
      when s.loan is null then named_struct('loan', s.loan, 'done', {result(none)})
      when o.op = 'return' then named_struct('loan', cast(null as {loan_type}), 'done', {result(ok, says_in)})
      else named_struct('loan', cast({extended} as {loan_type}), 'done', {result(ok, says_more, more)}) end"""
    folded = j.withColumn("f", F.expr(f"aggregate(ops, named_struct('loan', cast(loan as {loan_type}), 'done', cast(array() as {done})), (s, o) -> {step})"))
    after = folded.where("f.loan is not null").select("f.loan.*")
    seen = folded.where("loan is not null").select("loan.id", "loan.barcode")
    each = folded.select("barcode", F.explode("f.done").alias("d")).select("d.*", "barcode")
    return Circulated(
        loans.select(*names).join(seen, ["id", "barcode"], "left_anti").select(*names).unionByName(after),
        each.select("seq", "op", "barcode", F.col("error").isNull().alias("success"), "error", "dueDate"),
        each.where("action is not null").select("seq", "action"),
        folded.where("loan is not null").select("loan.*"),
        after,
    )


def _parts(what: str) -> list[str]:
    """A message's texts and, at odd places, its placeholders' names."""
    return re.split(r"\{(\w+)\}", SAYS.get(what) or LOGS[what])


def _spelled(what: str, **values: str) -> str:
    """What the desk says or logs as SQL: expressions stand for the placeholders."""
    quoted = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"concat({', '.join(f'cast({values[p]} as string)' if i % 2 else quoted(p) for i, p in enumerate(_parts(what)) if i % 2 or p)})"


def said(what: str, **values: Column | str) -> Column:
    """What the desk says (or logs) as a column: columns stand for the message's placeholders."""
    value = lambda v: (F.col(v) if isinstance(v, str) else v).cast("string")
    return F.concat(*[value(values[p]) if i % 2 else F.lit(p) for i, p in enumerate(_parts(what)) if i % 2 or p])


def resolve(todo: DataFrame, media: DataFrame, ordinal: str = "title") -> DataFrame:
    """Scanned barcodes of many commands to the catalogue's: id, barcode, title, and an error if unknown or in a box.

    Of several resources with a barcode the first by id counts, of rows of one id the first by ordinal.
    """
    own = exploded(media, "K2", "id", F.col(ordinal).alias("nth"), "title").groupBy(F.lower("copy").alias("key")).agg(F.min(F.struct("id", "nth", "title", "copy")).alias("m"))
    box = boxes.containing(media, ordinal=ordinal).select("id", F.col("barcode").alias("copy"), "boxBarcode", "boxTitle")
    kept = [c for c in todo.columns if c not in ("barcode", "title")]
    j = todo.select(*kept, F.col("barcode").alias("scanned")).withColumn("key", F.lower("scanned")).join(own, "key", "left")
    j = j.select(*kept, "scanned", "m.id", "m.title", "m.copy").join(box, ["id", "copy"], "left")
    in_box = said("boxed out", title="title", barcode="copy", boxTitle="boxTitle", boxBarcode="boxBarcode")
    error = F.when(F.col("copy").isNull(), said("unknown", barcode="scanned")).when(F.col("boxBarcode").isNotNull(), in_box)
    return j.withColumn("error", error).withColumn("barcode", F.coalesce("copy", "scanned")).drop("copy", "boxBarcode", "boxTitle")


@dataclass(frozen=True)
class Desk:
    """A state of the library. Each command gives the next state and its outcome; audit collects (user, action).

    ordinal: the column by which rows of equal id or barcode are in order (the first counts).
    """

    borrowers: DataFrame
    media: DataFrame
    loans: DataFrame
    user: str = ""
    as_of: D.Day = None
    audit: tuple[tuple[str, str], ...] = field(default=())
    ordinal: str = "id"

    # -- helpers --

    def _log(self, action: str) -> Desk:
        return replace(self, audit=(*self.audit, (self.user, action)))

    def _one(self, df: DataFrame) -> Row | None:
        return next(iter(df.head(1)), None)

    def _text(self, c: Column) -> str:
        return self.loans.sparkSession.range(1).select(c).first()[0]

    def _box(self, resource: str, barcode: str) -> Row | None:
        own = self.media.where(same_id("id", resource))
        held = boxes.entries(own).where(F.col("barcode") == barcode)
        if not (e := self._one(held)):
            return None
        found = self._one(exploded(self.media, "K2", "title", self.ordinal).where(F.col("copy") == e["boxBarcode"]).orderBy(self.ordinal))
        return Row(boxBarcode=e["boxBarcode"], boxTitle=(found and found["title"]) or e["boxBarcode"])

    def audit_rows(self) -> DataFrame:
        return self.loans.sparkSession.createDataFrame(list(self.audit), "User string, Action string").select(F.current_timestamp().alias("Timestamp"), "User", "Action")

    # -- checkout --

    def _checkout(self, borrower: str, barcode: str, name: str, title: str, days: int) -> tuple[Desk, dict]:
        if self._one(self.loans.where(F.col("barcode") == barcode)):
            return self, {"success": False, "error": SAYS["taken"]}
        spark = self.loans.sparkSession
        day = D.day(self.as_of)
        # its number tells apart the ids of one session's loans of a barcode
        row = spark.createDataFrame([(barcode, title, name, borrower, len(self.audit))], "barcode string, title string, borrowerName string, borrowerId string, n long")
        row = row.select(R.seeded_id("L", "barcode", "borrowerId", "n", day.cast("string")).alias("id"), "barcode", "title", D.show(day).alias("checkoutDate"), D.show(F.date_add(day, days)).alias("dueDate"), "borrowerName", "borrowerId")
        return replace(self, loans=R.insert(self.loans, "Loans", row)), {"success": True, "title": title, "barcode": barcode}

    def checkout(self, borrower: str, barcode: str, resource: str, title: str, name: str, days: int = LOAN_DAYS) -> tuple[Desk, dict]:
        """By the catalogue's barcode; logged whether or not it succeeds. The resource's id is not used."""
        return self._log(LOGS["out"].format(title=title, barcode=barcode, name=name, borrower=borrower, days=days))._checkout(borrower, barcode, name, title, days)

    def checkout_by_barcode(self, borrower: str, barcode: str, name: str, days: int = LOAN_DAYS) -> tuple[Desk, dict]:
        m = self._one(owner_of(self.media, barcode, self.ordinal))
        if not m:
            return self, {"success": False, "notFound": True, "error": SAYS["unknown"].format(barcode=barcode)}
        return self._boxed_checkout(m["id"], m["copy"], m["title"], borrower, name, days, "out")

    def _boxed_checkout(self, resource: str, copy: str, title: str, borrower: str, name: str, days: int, what: str) -> tuple[Desk, dict]:
        if box := self._box(resource, copy):
            return self, {"success": False, "error": SAYS["boxed out"].format(title=title, barcode=copy, **box.asDict())}
        after, out = self._checkout(borrower, copy, name, title, days)
        return (after._log(LOGS[what].format(title=title, barcode=copy, name=name, borrower=borrower, days=days)) if out["success"] else after), out

    def checkout_by_resource(self, borrower: str, resource: str | int, name: str, days: int = LOAN_DAYS) -> tuple[Desk, dict]:
        """Only if exactly one copy is free: then it is known which one was taken."""
        own = by_id(self.media, resource, self.ordinal)
        m = self._one(own)
        if not m:
            return self, {"success": False, "error": SAYS["no resource"]}
        on = self.loans.select(k3_loan("barcode").alias("key")).distinct()
        free = exploded(own, "K2").join(on, F.lower("copy") == F.col("key"), "left_anti").collect()  # one resource's copies
        if len(free) != 1:
            return self, {"success": False, "error": SAYS["many free" if free else "none free"].format(title=m["title"], n=len(free))}
        return self._boxed_checkout(m["id"], free[0]["copy"], m["title"], borrower, name, days, "out by name")

    # -- return --

    def _return(self, loan: str) -> tuple[Desk, dict]:
        got = self._one(by_id(self.loans, loan, self.ordinal))
        if not got:
            return self, {"success": False, "error": SAYS["no loan"]}
        return replace(self, loans=R.delete(self.loans, loan, self.ordinal)), {"success": True, "data": got.asDict()}

    def return_by_id(self, loan: str) -> tuple[Desk, dict]:
        after, out = self._return(loan)
        return after._log(LOGS["in by id"].format(outcome=json.dumps(out, ensure_ascii=False, separators=(",", ":")))), {k: v for k, v in out.items() if k != "data"}

    def return_by_barcode(self, barcode: str) -> tuple[Desk, dict]:
        loan = self._one(loan_of(self.loans, barcode, self.ordinal))
        if not loan:
            return self, {"success": False, "error": SAYS["not loaned"].format(barcode=barcode)}
        owner = self._one(owner_of(self.media, barcode, self.ordinal))
        if owner and (box := self._box(owner["id"], loan["barcode"])):
            return self, {"success": False, "error": SAYS["boxed in"].format(title=loan["title"], barcode=loan["barcode"], **box.asDict())}
        after, out = self._return(loan["id"])
        if not out["success"]:
            return after, out
        return after._log(LOGS["in"].format(title=loan["title"], barcode=loan["barcode"], name=loan["borrowerName"])), {"success": True, "title": loan["title"], "borrowerName": loan["borrowerName"]}

    # -- extend --

    def _extend(self, loan: str, days: int) -> tuple[Desk, dict]:
        got = self._one(by_id(self.loans, loan, self.ordinal).withColumn("new", D.later("dueDate", days)))
        if not got:
            return self, {"success": False, "error": SAYS["no loan"]}
        new = got["new"] or got["dueDate"]
        return replace(self, loans=R.update(self.loans, loan, {"dueDate": new}, self.ordinal)), {"success": True, "newDueDate": new}

    def extend(self, loan: str, days: int = LOAN_DAYS) -> tuple[Desk, dict]:
        """From the current due date, not from today; logged whether or not it succeeds."""
        after, out = self._log(LOGS["more by id"].format(loan=loan, days=days))._extend(loan, days)
        return after, {k: v for k, v in out.items() if k != "newDueDate"}

    def extend_by_barcode(self, barcode: str, days: int = LOAN_DAYS) -> tuple[Desk, dict]:
        scanned = self.loans.sparkSession.createDataFrame([(barcode,)], "barcode string")
        if not self._one(in_catalogue(self.media, scanned)):
            return self, {"success": False, "error": SAYS["unknown"].format(barcode=barcode)}
        loan = self._one(loan_of(self.loans, barcode, self.ordinal))
        if not loan:
            return self, {"success": False, "error": SAYS["not out"].format(barcode=barcode)}
        after, out = self._extend(loan["id"], days)
        if not out["success"]:
            return after, out
        return after._log(LOGS["more"].format(title=loan["title"], barcode=loan["barcode"], days=days)), out | {"title": loan["title"]}

    # -- members and resources --

    def save(self, table: str, row: dict[str, str]) -> tuple[Desk, dict]:
        """Create a member or resource, or update the one whose id is given. table: Borrowers or Media."""
        what, label = {"Borrowers": ("borrower", "name"), "Media": ("media", "title")}[table]
        key = table.lower()
        df = getattr(self, key)
        fields = {c: row.get(c) or "" for c in TABLES[table].names if c != "id"}
        if row.get("id"):
            after = self._log(LOGS["updated"].format(kind=what, name=fields[label], id=row["id"]))
            if not self._one(by_id(df, row["id"])):
                return after, {"success": False, "error": f"{table} with ID {row['id']} not found"}
            given = {c: v for c, v in fields.items() if c in row}
            return replace(after, **{key: R.update(df, row["id"], given, self.ordinal)}), {"success": True}
        after = self._log(LOGS["created"].format(kind=what, name=fields[label]))
        new = df.sparkSession.createDataFrame([tuple(fields.values())], ", ".join(f"{c} string" for c in fields))
        new = new.withColumn("id", R.seeded_id(table[0], *fields, F.lit(len(self.audit))))
        return replace(after, **{key: R.insert(df, table, new)}), {"success": True}

    def delete_media(self, resource: str) -> tuple[Desk, dict]:
        """Refused while a copy is on loan and not yet due; overdue loans go with the resource.

        A loan whose due date cannot be read is neither, and stays behind.
        """
        m = self._one(by_id(self.media, resource, self.ordinal))
        if not m:
            return self, {"success": False, "error": SAYS["no resource"]}
        own = A.loans_of(self.loans, self.media, m["id"])
        if n := own.where(D.not_yet_due("dueDate", self.as_of)).count():
            one = n == 1
            return self, {"success": False, "error": SAYS["current"].format(title=m["title"], n=n, copies="copy is" if one else "copies are", it="it" if one else "them")}
        after = self
        for loan in own.where(D.overdue("dueDate", self.as_of)).orderBy(self.ordinal).collect():  # one resource's copies
            after = replace(after, loans=R.delete(after.loans, loan["id"], self.ordinal))
            after = after._log(LOGS["lost"].format(title=m["title"], barcode=loan["barcode"], loan=loan["id"], name=loan["borrowerName"]))
        after = after._log(LOGS["deleted"].format(title=m["title"], resource=resource))
        return replace(after, media=R.delete(after.media, resource, self.ordinal)), {"success": True}

    def opened(self, what: str = "the library") -> Desk:
        """The start of a session, once for each visit."""
        return self._log(LOGS["opened"].format(what=what))

    def user_error(self, message: str | None) -> Desk:
        """An error that a user saw, cut to 500 characters."""
        return self._log(f"error shown to user: {(message or '')[:500]}")


def logged_error(message: Column | str) -> Column:
    return F.concat(F.lit("error shown to user: "), cut(message))




def logged_session(what: str = "the library") -> Column:
    return F.lit(LOGS["opened"].format(what=what))
