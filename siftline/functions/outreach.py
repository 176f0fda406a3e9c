"""Outreach as a state machine: what happened with a contact, in order, and what to do next (SCO-24).

The machine is a table of transitions.  A contact's events are folded through it by one
expression, so a contact is one row and nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

L = F.lit

# Fixed values: (state, event) -> state; what is not listed changes nothing.  A message to somebody contacted is a nudge.
TRANSITIONS = {
    ("SUGGESTED", "DRAFT"): "DRAFTED", ("SUGGESTED", "SEND"): "CONTACTED", ("DRAFTED", "SEND"): "CONTACTED", ("CONTACTED", "SEND"): "CONTACTED", ("CONTACTED", "REPLY"): "REPLIED",
    ("SUGGESTED", "ARCHIVE"): "ARCHIVED", ("DRAFTED", "ARCHIVE"): "ARCHIVED", ("CONTACTED", "ARCHIVE"): "ARCHIVED", ("REPLIED", "ARCHIVE"): "ARCHIVED",
}
# Days until the first nudge, from it until the second, nudges at most, days beyond which a nudge is urgent.
FIRST_NUDGE, SECOND_NUDGE, MOST_NUDGES, URGENT_AFTER = 3, 5, 2, 3


def contact_states(events: DataFrame, key: str) -> DataFrame:
    """key, status, contacted_at, last_nudge_at, nudges, replied_at of each contact after its events (key, at, seq, event), in order of (at, seq)."""
    table = F.create_map(*[x for (state, event), after in TRANSITIONS.items() for x in (L(f"{state} {event}"), L(after))])
    none = L(None).cast("timestamp")
    start = F.struct(L("SUGGESTED").alias("status"), none.alias("contacted_at"), none.alias("last_nudge_at"), L(0).alias("nudges"), none.alias("replied_at"))

    def step(s: Column, e: Column) -> Column:
        after = F.try_element_at(table, F.concat_ws(" ", s["status"], e["event"]))
        first = F.coalesce((after == "CONTACTED") & (s["status"] != "CONTACTED"), L(False))
        nudge = F.coalesce((after == "CONTACTED") & (s["status"] == "CONTACTED"), L(False))
        return F.struct(
            F.coalesce(after, s["status"]).alias("status"), F.when(first, e["at"]).otherwise(s["contacted_at"]).alias("contacted_at"), F.when(nudge, e["at"]).otherwise(s["last_nudge_at"]).alias("last_nudge_at"),
            F.when(nudge, s["nudges"] + 1).otherwise(s["nudges"]).alias("nudges"), F.when(after == "REPLIED", e["at"]).otherwise(s["replied_at"]).alias("replied_at"))

    ordered = F.array_sort(F.collect_list(F.struct("at", "seq", "event")))
    folded = events.where("event is not null").groupBy(key).agg(ordered.alias("__e")).select(key, F.aggregate("__e", start, step).alias("s"))
    return folded.select(key, "s.*")


def next_action(status: Column, contacted_at: Column, last_nudge_at: Column, nudges: Column, now: Column) -> Column:
    """struct(action, label, due, urgency, days_since): first nudge after 3 days of silence, a second after 5 more, then rest."""
    waited = F.greatest(L(0).cast("long"), F.floor((F.unix_micros(now) - F.unix_micros(F.coalesce(last_nudge_at, contacted_at, now))) / 86_400_000_000))
    limit = F.when(nudges == 0, FIRST_NUDGE).otherwise(SECOND_NUDGE)
    action = (
        F.when(status == "REPLIED", "REPLIED").when(status == "DRAFTED", "CONTACT").when(status != "CONTACTED", "NONE").when(nudges >= MOST_NUDGES, "RESTING")
        .when(waited < limit, "AWAIT").when(nudges >= 1, "FOLLOW_UP_2").otherwise("FOLLOW_UP"))
    left = limit - waited
    label = (
        F.when(action == "REPLIED", "Replied — take it forward").when(action == "CONTACT", "Send your intro").when(action == "RESTING", "Two nudges sent — let it rest").when(action == "FOLLOW_UP_2", "Second nudge is due")
        .when(action == "FOLLOW_UP", "Follow up — no reply yet").when(action == "AWAIT", F.concat(L("Follow up in "), left.cast("string"), F.when(left == 1, " day").otherwise(" days"))).otherwise(""))
    nudge = action.isin("FOLLOW_UP", "FOLLOW_UP_2")
    urgency = F.when(action == "REPLIED", 3).when(action == "CONTACT", 2).when(nudge, F.when(waited >= limit + URGENT_AFTER, 3).otherwise(2)).when(action == "AWAIT", 1).otherwise(0)
    return F.struct(action.alias("action"), label.alias("label"), (nudge | action.isin("REPLIED", "CONTACT")).alias("due"), urgency.alias("urgency"), F.when(status == "CONTACTED", waited).alias("days_since"))
