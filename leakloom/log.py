"""Log lines as JSON objects, one a line."""

from __future__ import annotations

import datetime as dt
import json
import logging


class JsonLines(logging.Formatter):
    """time (UTC), level, logger, message, place, the error's text, and what ``extra`` names."""

    _own = frozenset(vars(logging.makeLogRecord({}))) | {"message", "asctime"}

    def format(self, record: logging.LogRecord) -> str:
        out = {"timestamp": dt.datetime.fromtimestamp(record.created, dt.UTC).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage(), "module": record.module, "function": record.funcName, "line": record.lineno}
        if record.exc_info:
            out["exception"] = self.formatException(record.exc_info)
        out |= {k: v for k, v in vars(record).items() if k not in self._own}
        return json.dumps(out, ensure_ascii=False, default=str)
