"""Fixed values of the session log format."""

from __future__ import annotations

#: The known event types (fixed values).
EVENT_TYPES = ("assistant", "user", "file-history-snapshot", "queue-operation", "attachment", "pr-link", "ai-title", "last-prompt", "progress", "system")
