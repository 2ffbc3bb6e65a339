"""Logging of the package: standard output and, if wanted, a file; other libraries speak up from warnings on. [B8]"""

from __future__ import annotations

import logging
import sys

FORMAT = "%(asctime)s %(levelname)s %(name)s: %(message)s"
TALKATIVE = ("py4j", "urllib3", "PIL", "matplotlib")


def set_up(level: str = "INFO", path: str | None = None) -> logging.Logger:
    """The package's logger with its handlers; a second call replaces those of the first."""
    log = logging.getLogger("lodeseek")
    log.setLevel(level)
    log.propagate = False
    for h in log.handlers[:]:
        log.removeHandler(h)
        h.close()
    for h in [logging.StreamHandler(sys.stdout), *([logging.FileHandler(path, encoding="utf-8")] if path else [])]:
        h.setFormatter(logging.Formatter(FORMAT))
        log.addHandler(h)
    for name in TALKATIVE:
        logging.getLogger(name).setLevel(logging.WARNING)
    return log
