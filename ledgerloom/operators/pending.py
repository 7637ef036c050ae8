"""Issues closed by evidence: which are resolved, by what, and which stay for review.

All evidence is about observations (rows of a view) or about the events that views make of them, in long tables, so an
issue meets only what concerns its rows, by equi-joins, and is judged by one grouped aggregate. Resolved and pending
issues together are the issues given, each once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import text

DOC = "document_id"

#: A basis, and the code or codes and the field (None: any) of the issues that it can close. The first that holds counts.
BASES = (
    ("OWNER_NAME_BOUND_TO_ACCOUNT", ("OUTSIDE_TRANSACTION_SOURCES", "INVALID_SOURCE_FRAGMENT"), "account_name"),
    ("ISSUER_READ_INDEPENDENTLY", ("INVALID_SOURCE_FRAGMENT",), "bank_name"),
    ("PLACEHOLDER_IN_BOTH_READINGS", ("UNREADABLE_SOURCE", "INDEPENDENT_VALUE_CONFLICT", "INDEPENDENT_SOURCE_UNCERTAIN"), "counterparty_account"),
    ("ACCOUNT_READ_TWICE", ("MISSING_KEY_SOURCE",), "account_number"),
    ("DIRECTION_READ_TWICE", ("DIRECTION_REQUIRES_INDEPENDENT_READ",), None),
    ("PARTY_PRESENT", ("COUNTERPARTY_IDENTITY_MISSING",), None),
    ("CASH_WITHOUT_PARTY", ("COUNTERPARTY_IDENTITY_MISSING",), None),
    ("LISTED_ACCOUNT_IN_DETAILED_VIEW", ("INDEPENDENT_VALUE_CONFLICT",), "account_number"),
    ("OTHER_VIEW_AGREES", ("INDEPENDENT_VALUE_CONFLICT",), None),
    ("LISTED_ACCOUNT_IN_ROWS", ("DUPLICATE_VIEW_CONFLICT",), "account_number"),
    ("READ_IN_EVERY_DIFFERING_VIEW", ("DUPLICATE_VIEW_CONFLICT",), None),
)


def judged_issues(issues: DataFrame, observations: DataFrame, values: DataFrame, chosen: DataFrame, listed: DataFrame, issuers: DataFrame) -> DataFrame:
    """(document_id, issue_no, code, field, state, basis): state is RESOLVED with a basis, or PENDING.

    issues: (document_id, issue_no, code, field, observations), which must hold for all rows that it names; one that
    names none stays pending. observations: (document_id, obs, event, direct_owner, name_bound, placeholder, cash,
    party_present, party_blank): name_bound, an owner's name bound to the account; placeholder, a question mark for the
    other party's account in both readings of interest paid by the bank; cash, a cash transaction; party_blank, both
    party cells and the reading's are empty without doubt. values: (document_id, obs, field, printed, read), read null
    without an aligned reading. chosen: (document_id, event, field, value) of the events. listed: (document_id, account)
    of lists of accounts. issuers: (document_id, issuer) confirmed by an independent reading.

    A conflict between print and reading of one row is closed if the reading gives the event's value and another view
    prints it, or if a view with accounts in its rows prints and reads an account that is listed while the row's isn't.
    A conflict of views is closed if each differing row's reading gives the chosen value, or if the chosen account is
    listed, printed by a row of a detailed view, and no differing row is detailed or listed.
    """
    pairs = values.select(DOC, "obs", "field", text("printed").alias("printed"), "read")
    accounts = listed.select(DOC, F.col("account").alias("_account"), F.lit(True).alias("_listed")).distinct()
    picked = chosen.select(DOC, "event", "field", text("value").alias("value")).join(accounts.withColumnsRenamed({"_account": "value", "_listed": "value_listed"}), [DOC, "value"], "left")
    shown = pairs.join(observations.select(DOC, "obs", "event", "direct_owner"), [DOC, "obs"]).join(picked.select(DOC, "event", "field", "value"), [DOC, "event", "field"])
    same = F.col("printed") == F.col("value")
    support = shown.groupBy(DOC, "event", "field").agg(F.count_if(same).alias("_same"), F.count_if(same & F.col("direct_owner")).alias("_rows"), F.count_if(same & F.col("direct_owner") & (F.col("read") == F.col("value"))).alias("_full"))
    each = issues.select(DOC, "issue_no", "code", "field", F.size("observations").alias("_n"), F.explode("observations").alias("obs")).join(observations, [DOC, "obs"], "left").join(pairs, [DOC, "obs", "field"], "left")
    each = each.join(picked, [DOC, "event", "field"], "left").join(support, [DOC, "event", "field"], "left").join(issuers, DOC, "left")
    each = each.join(accounts.withColumnsRenamed({"_account": "printed", "_listed": "printed_listed"}), [DOC, "printed"], "left").join(accounts.withColumnsRenamed({"_account": "read", "_listed": "read_listed"}), [DOC, "read"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    filled, agrees = F.col("printed") != "", (F.col("printed") != "") & (F.col("printed") == F.col("read"))
    differs = yes(filled & (F.col("printed") != F.col("value")))
    listed_value = yes(F.col("value_listed"))
    holds = {
        "OWNER_NAME_BOUND_TO_ACCOUNT": F.col("name_bound"),
        "ISSUER_READ_INDEPENDENTLY": filled & (F.col("printed") == F.col("issuer")),
        "PLACEHOLDER_IN_BOTH_READINGS": F.col("placeholder"),
        "ACCOUNT_READ_TWICE": agrees,
        "DIRECTION_READ_TWICE": agrees,
        "PARTY_PRESENT": F.col("party_present"),
        "CASH_WITHOUT_PARTY": F.col("cash") & F.col("party_blank") & ~yes(F.col("party_present")),
        "LISTED_ACCOUNT_IN_DETAILED_VIEW": (F.col("_n") == 1) & ~F.col("direct_owner") & listed_value & ~yes(F.col("read_listed")) & (F.col("_full") > 0),
        "OTHER_VIEW_AGREES": (F.col("_n") == 1) & (F.col("read") == F.col("value")) & (F.col("_same") - yes(F.col("printed") == F.col("value")).cast("int") > 0),
        "LISTED_ACCOUNT_IN_ROWS": listed_value & (F.col("_rows") > 0) & (~differs | (~F.col("direct_owner") & ~yes(F.col("printed_listed")))),
        "READ_IN_EVERY_DIFFERING_VIEW": F.col("value").isNotNull() & (~differs | yes(F.col("read") == F.col("value"))),
    }
    per = each.groupBy(DOC, "issue_no").agg(*[F.bool_and(yes(c)).alias(name) for name, c in holds.items()])
    basis = F.coalesce(*[F.when(F.col("code").isin(*codes) & (F.lit(True) if field is None else text("field") == field) & yes(F.col(name)), name) for name, codes, field in BASES])
    return issues.select(DOC, "issue_no", "code", "field").join(per, [DOC, "issue_no"], "left").withColumn("basis", basis).select(DOC, "issue_no", "code", "field", F.when(F.col("basis").isNull(), "PENDING").otherwise("RESOLVED").alias("state"), "basis")
