"""Progress of running streams as plain rows."""

from __future__ import annotations

from pyspark.sql.streaming.listener import StreamingQueryListener


class ProgressLog(StreamingQueryListener):
    """Keeps the last ``keep`` events of all streams of a session as dictionaries."""

    def __init__(self, keep: int = 1000):
        self.keep, self.events = keep, []

    def _note(self, **event) -> None:
        self.events.append(event)
        del self.events[: -self.keep]

    def onQueryStarted(self, event) -> None:
        self._note(kind="started", id=str(event.id), name=event.name)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._note(kind="progress", id=str(p.id), name=p.name, batch=p.batchId, rows=p.numInputRows)

    def onQueryIdle(self, event) -> None:
        self._note(kind="idle", id=str(event.id))

    def onQueryTerminated(self, event) -> None:
        self._note(kind="terminated", id=str(event.id), error=event.exception)
