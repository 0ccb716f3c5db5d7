"""Column contracts of the core tables, as DDL."""

BARS = """
    asset_id string, source string, row_seq bigint, session date,
    session_open_at timestamp, session_close_at timestamp, available_at timestamp,
    open decimal(18,6), high decimal(18,6), low decimal(18,6), close decimal(18,6),
    volume decimal(24,6)
"""

SESSIONS = """
    calendar_id string, session date, session_open_at timestamp, session_close_at timestamp
"""

TARGETS = """
    asset_id string, session date, decision_at timestamp, effective_at timestamp, weight int
"""

PRICE_FIELDS = ("open", "high", "low", "close")
PRICE = "decimal(18,6)"
VOLUME = "decimal(24,6)"
