"""python -m memquarry ROOT COMMAND ...: status, search QUERY, ingest FILE, sessions PATH, reason TITLE CONTENT EVIDENCE, bank, skills, audit, dedup."""

from __future__ import annotations

import sys

from memquarry.engine import Engine
from memquarry.session import local_session


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    root, command, *rest = args
    engine = Engine(local_session(), root)
    if command == "ingest":
        print(engine.ingest_file(*rest))
    elif command == "reason":
        print(*engine.add_entry(rest[0], rest[1], [], rest[2:]))
    else:
        show = {"status": engine.status, "search": engine.search, "sessions": engine.ingest_sessions, "bank": engine.entries, "skills": engine.skills, "audit": engine.audit_log, "dedup": engine.dedup_stats}
        if command not in show:
            print(__doc__)
            return 2
        show[command](*rest).show(50, truncate=120)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
