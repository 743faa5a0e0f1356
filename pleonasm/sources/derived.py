"""Inputs made from the relational tables, for operators the given prose cannot exercise.

The expressions use only what Spark SQL and ANSI SQL engines share, so the check side builds the
very same rows. Every input grows with its source table.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Derived:
    table: str
    columns: dict[str, str]
    where: str = ""

    def sql(self) -> str:
        columns = ", ".join(f"{expression} AS {name}" for name, expression in self.columns.items())
        return f"SELECT {columns} FROM {self.table}" + (f" WHERE {self.where}" if self.where else "")


def _case(selector: str, *branches: str) -> str:
    """`branches[selector]` as a CASE expression."""
    whens = " ".join(f"WHEN {i} THEN {branch}" for i, branch in enumerate(branches[:-1]))
    return f"CASE {selector} {whens} ELSE {branches[-1]} END"


def _pick(selector: str, words) -> str:
    return _case(selector, *[f"'{word}'" for word in words])


_K = "CAST(o_orderkey AS STRING)"
_C = "CAST(o_custkey AS STRING)"
_PRICE = "CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)"
_DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_MONTH_NAMES = (
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
    "November", "December",
)
_WRITTEN_DAY = (
    _pick("month(o_orderdate) - 1", _MONTH_NAMES)
    + " || ' ' || CAST(day(o_orderdate) AS STRING) || ', ' || CAST(year(o_orderdate) AS STRING)"
)
_ONES = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven",
    "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
)
_TENS = ("", "ten", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")


def number_words(n: str) -> str:
    """SQL text for the words of an integer below one million."""

    def below_hundred(v: str) -> str:
        ones = _pick(f"CAST({v} AS INT)", _ONES)
        tens = _pick(f"CAST(floor({v} / 10) AS INT)", _TENS)
        unit = _pick(f"CAST({v} % 10 AS INT)", _ONES)
        return f"(CASE WHEN {v} < 20 THEN {ones} WHEN {v} % 10 = 0 THEN {tens} ELSE {tens} || '-' || {unit} END)"

    def below_thousand(v: str) -> str:
        hundreds = _pick(f"CAST(floor({v} / 100) AS INT)", _ONES[:10])
        rest = f"({v} % 100)"
        return (
            f"(CASE WHEN {v} < 100 THEN {below_hundred(v)} WHEN {rest} = 0 THEN {hundreds} || ' hundred'"
            f" ELSE {hundreds} || ' hundred ' || {below_hundred(rest)} END)"
        )

    return below_thousand(n)


# One sentence per order, grouped by customer: statuses, conflicts, negations.
_STATUS = _case(
    "o_orderkey % 10",
    f"'Order ORD-' || {_K} || ' was reviewed.'",
    f"'Service CACHE-' || {_C} || ' is degraded.'",
    f"'Service CACHE-' || {_C} || ' is not offline.'",
    f"'The region R-' || {_C} || ' is active.'",
    f"'Region R-' || {_C} || ' is inactive.'",
    "CASE WHEN o_orderkey % 20 < 10 THEN 'No customer records were deleted.' ELSE 'No customer records were exposed.' END",
    "CASE WHEN o_orderkey % 20 < 10 THEN 'Backup files were not modified.' ELSE 'Backup files were not deleted.' END",
    f"'Order ORD-' || {_K} || ' is pending.'",
    f"'Shard S-' || {_C} || CASE WHEN o_orderkey % 20 < 10 THEN ' was migrated.' ELSE ' was not migrated.' END",
    f"'Order ORD-' || {_K} || ' was not approved, however it is still in transit.'",
)

# One sentence per order: dates, money, shares, durations, addresses, ids.
_FACT = _case(
    "o_orderkey % 8",
    f"'Order ORD-' || {_K} || ' closed at $' || {_PRICE} || ' on ' || {_DAY} || ' and again on ' || {_WRITTEN_DAY} || '.'",
    "'The rollout paused at ' || CASE WHEN o_orderkey % 16 < 8 THEN '83%' ELSE 'eighty-three percent' END || ' for region us-east-1.'",
    "'Write latency increased from 12 ms to ' || CASE WHEN o_orderkey % 16 < 8 THEN '28 ms' ELSE 'twenty-eight ms' END || '.'",
    f"'Contact ops' || {_C} || '@example.com about Clause 4.2 of policy_' || {_C} || '_main.'",
    "'The call starts at 9:30 PM and ends at ten thirty PM.'",
    f"'The fee was ' || {number_words('(o_orderkey % 1000)')} || ' dollars and took ' || {number_words('(o_orderkey % 60)')} || ' minutes.'",
    f"'Scan of node N-' || {_C} || ' started on ' || {_DAY} || ' and took 5 minutes.'",
    f"'See https://example.com/orders/' || {_K} || ' for CUSIP 0378' || {_C} || '.'",
)

_ITEMS = ("the order ID", "the customer email", "purchase date and refund reason", "product SKU", "the order ID")
# One sentence per order: repeated frames that can become one list, and what blocks them.
_FRAME = _case(
    "o_orderkey % 11",
    "'Agents must verify ' || " + _pick("CAST(floor(o_orderkey / 11) AS BIGINT) % 5", _ITEMS) + " || '.'",
    f"'Cohort C-' || {_K} || ' was affected.'",
    f"'Biomarker B-' || {_K} || ' is healthy.'",
    f"'Do not claim Job J-' || {_K} || CASE WHEN o_orderkey % 22 < 11 THEN ' was deleted.' ELSE ' was migrated.' END",
    "'Do not merge ' || CASE WHEN o_orderkey % 22 < 11 THEN 'this' ELSE 'the' END || ' conflict in the ledger.'",
    "'The ledger says ' || CAST(o_orderkey % 7 AS STRING) || ' but the log differs.'",
    f"'Formula y = x + ' || {_C} || CASE WHEN o_orderkey % 22 < 11 THEN ' appears in the appendix.' ELSE ' must be preserved exactly.' END",
    f"'Server N-' || {_C} || ' failed over' || CASE WHEN o_orderkey % 22 < 11 THEN '.' ELSE ' because the disk was full.' END",
    f"'Policy P-' || {_K} || ' was reviewed.'",
    "'Support logged ' || CAST(o_orderkey % 9 + 1 AS STRING) || CASE WHEN o_orderkey % 22 < 11 THEN ' billing' ELSE ' login' END || ' complaints.'",
    f"'Job J-' || {_K} || ' was not deleted, later it was paused.'",
)

_THEMES = (
    "'Reliability must be preserved.'",
    "'The migration should not reduce availability or customer experience.'",
    "'Agents must verify the order ID and the customer email.'",
    "'Support should confirm the purchase date and the product SKU.'",
    "'The platform saves time and reduces manual work.'",
    "'The product improves reporting accuracy.'",
    "'Do not reveal API keys or secrets.'",
    "'Never expose access tokens or credentials.'",
    "'The company reduced cloud infrastructure costs through compute optimization.'",
    "'Lower cloud spending improved operating margins and financial performance by 12%.'",
    "'However, cloud costs increased and efficiency decreased.'",
    "'Trial users cannot access the export feature.'",
    "'The report is due on Friday.'",
    f"'Invoice total was $' || {_PRICE} || ' for the region.'",
    "'We might need additional funding next quarter.'",
)

_PAIRS = ("ALPHA", "BETA", "GAMMA", "DELTA")
_A, _B = _pick("o_custkey % 4", _PAIRS), _pick("(o_custkey + 1) % 4", _PAIRS)
# One sentence per order: claims that repeat, rephrase or contradict each other.
_CLAIM = _case(
    "o_orderkey % 9",
    f"{_A} || ' is better than ' || {_B} || '.'",
    f"{_B} || ' is not better than ' || {_A} || '.'",
    f"{_A} || ' is easier than ' || {_B} || '.'",
    f"{_B} || ' is really harder than ' || {_A} || '.'",
    f"'My name is Person' || {_C} || '.'",
    f"'Person' || {_C} || ' is my name.'",
    f"{_A} || ' is ' || " + _pick("CAST(floor(o_orderkey / 9) AS BIGINT) % 3", ("fast", "slow", "easy")) + " || '.'",
    f"'Service' || {_C} || ' must encrypt all backups.'",
    f"'Service' || {_C} || ' can export reports' || CASE WHEN o_orderkey % 18 < 9 THEN '.' ELSE ' because it is licensed.' END",
)

_NL = "chr(10)"
# A sectioned prompt per document: instructions, four retrieved chunks, a ticket and a task.
_PROMPT = " || ".join(
    [
        "'You help customers.'", _NL,
        "'System Instructions:'", _NL, "'Answer briefly. Never promise approval.'", _NL,
        "'Chunk A' || CAST(doc_id % 10 AS STRING) || ':'", _NL,
        "'Agents must verify the order ID and the customer email. Agents must verify the order ID and the customer email.'", _NL,
        "'Chunk B:'", _NL,
        "'Refunds over $' || CAST(500 + 100 * (doc_id % 3) AS STRING) || ' require Finance approval. Confirm the order ID, purchase date.'", _NL,
        "'Source 3:'", _NL,
        "CASE doc_id % 4 WHEN 0 THEN 'Finance must review refunds above $500.' WHEN 1 THEN 'Uptime was 99.9% in March.'"
        " WHEN 2 THEN 'Latency dropped from 120 ms to 80 ms.' ELSE 'Customers may request a refund within 30 days.' END", _NL,
        "'Policy excerpt:'", _NL, "text", _NL,
        "'Chunk D:'", _NL, "CASE WHEN doc_id % 5 = 0 THEN 'Latency dropped from 120 ms to 95 ms.' ELSE text END", _NL, _NL,
        "'Customer Ticket:'", _NL, "'Ticket ID: SUP-' || CAST(doc_id AS STRING)", _NL,
        "'Refund amount: $' || CAST(100 + doc_id % 900 AS STRING)", _NL, _NL,
        "'Task:'", _NL, "'Draft a reply.'",
    ]
)

# A support prompt per order: policy twice, a ticket, a reminder and a task.
_SUPPORT = " || ".join(
    [
        "'You are a support agent.'", _NL, _NL,
        "'Refund Policy:'", _NL,
        "'Customers may request a refund within 30 days if usage stays within the trial limit. Agents must verify the order ID and customer email.'", _NL, _NL,
        "'Internal Guidelines:'", _NL,
        "'Before a refund, verify the '|| CASE WHEN o_orderkey % 2 = 0 THEN 'purchase date' ELSE 'refund reason' END"
        " || '. Refunds over $' || CAST(500 + 50 * (o_orderkey % 4) AS STRING) || ' need Finance approval.'", _NL, _NL,
        f"'Customer Ticket:'", _NL, f"'Order ID: ORD-' || {_K}", _NL, f"'Refund amount: $' || {_PRICE}", _NL, _NL,
        "'Agent Reminder:'", _NL,
        "CASE WHEN o_orderkey % 3 = 0 THEN 'Do not promise approval. Tell the customer the request is under review.'"
        " WHEN o_orderkey % 3 = 1 THEN 'The request is under review.' ELSE 'Finance approval is needed above $750.' END", _NL, _NL,
        "'Task:'", _NL, "'Write a reply.'",
    ]
)

_FILLER = (
    "'Please please kindly answer ' || chr(32) || chr(32) || 'this , ' || text"
    + " || ' Thanks Thanks really really good ! You know you know. Better than X, better than Y. Please kindly reply please'"
)

_NOTE = {"prompt_id": "o_custkey", "pos": "o_orderkey"}

DERIVED: dict[str, Derived] = {
    "status_notes": Derived("orders", {**_NOTE, "sentence": _STATUS}),
    "fact_notes": Derived("orders", {**_NOTE, "sentence": _FACT}),
    "frame_notes": Derived("orders", {**_NOTE, "sentence": _FRAME}),
    "mention_notes": Derived(
        "orders",
        {
            **_NOTE,
            "sentence": _case(
                "o_orderkey % 4", f"'Node N-' || {_C} || ' was reviewed.'", f"'Node M-' || {_K} || ' was reviewed.'",
                f"'Node N-' || {_C} || ' was later paused.'", f"'Node M-' || {_C} || ' is fine.'",
            ),
        },
    ),
    "list_notes": Derived(
        "orders",
        {
            "prompt_id": "CAST(floor(o_orderkey / 3) AS BIGINT)",
            "pos": "o_orderkey",
            "sentence": _case(
                "o_orderkey % 3", f"'Policy P-' || {_K} || ' was reviewed.'",
                "'Policies P-' || CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS STRING) || ' and Q-1 were reviewed.'",
                f"'Policy Q-1 was reviewed.'",
            ),
        },
    ),
    "theme_notes": Derived("orders", {**_NOTE, "sentence": _case("o_orderkey % 15", *_THEMES)}),
    "claim_notes": Derived("orders", {**_NOTE, "sentence": _CLAIM}),
    "chunk_prompts": Derived("documents", {"prompt_id": "doc_id", "text": _PROMPT}),
    "support_prompts": Derived("orders", {"prompt_id": "o_orderkey", "text": _SUPPORT}),
    "filler_prompts": Derived("documents", {"prompt_id": "doc_id", "source": "source", "text": _FILLER}),
    "paragraph_prompts": Derived(
        "documents",
        {"doc_id": "doc_id", "text": f"text || {_NL} || {_NL} || text"},
    ),
    "number_phrases": Derived("events", {"event_id": "event_id", "phrase": number_words("(event_id % 1000)")}),
    "warning_notes": Derived(
        "orders",
        {
            "prompt_id": "o_custkey",
            "fact": f"'Order ORD-' || {_K} || ' was not deleted.'",
            "fact_pos": "2 * o_orderkey",
            "warning": "'Do not claim Order ORD-' || CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS STRING) || ' was deleted.'",
            "warning_pos": "2 * o_orderkey + 1",
        },
    ),
    "trace_log": Derived(
        "events",
        {
            "request_id": "event_id",
            "ts": "ts",
            "provider": _pick("user_id % 3", ("gemini", "openai", "dry-run")),
            "level": _pick("event_id % 3", ("safe", "balanced", "aggressive")),
            "original_tokens": "CAST(50 + event_id % 400 AS BIGINT)",
            "optimized_tokens": "CAST(50 + event_id % 400 - event_id % 37 AS BIGINT)",
            "output_tokens": "CAST(20 + event_id % 90 AS BIGINT)",
            "accepted": "event_id % 11 <> 0",
            "facts_kept": "event_id % 29 <> 0",
            "similarity": "0.5 + (event_id % 50) / CAST(100 AS DOUBLE)",
            "cache_key": "'user-' || CAST(user_id AS STRING)",
            "suite": "event_type",
            "category": "event_type || '-' || CAST(event_id % 4 AS STRING)",
            "response": "'answer ' || CAST(event_id AS STRING)",
        },
    ),
}
