"""Command line: setup, index, search, export."""

from __future__ import annotations

import argparse
import sys

from .operators.embedding import HashingProvider
from .plans.export import export_conversations
from .plans.index import Indexer
from .session import get_session
from .sources.messages import FETCH_LIMIT, read_messages


def parse_args(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="lodestream", description="Index and search documents and conversations on Spark")
    parser.add_argument("--root", default="collections", help="folder of the collections")
    parser.add_argument("--model", default="voyage-3-large", help="embedding model")
    parser.add_argument("--dimension", type=int, help="vector width; the model's by default")
    commands = parser.add_subparsers(dest="command")
    setup = commands.add_parser("setup", help="create the collections")
    setup.add_argument("--recreate", action="store_true", help="empty them if they exist")
    index = commands.add_parser("index", help="index the documents of a JSON file")
    index.add_argument("--file", required=True)
    index.add_argument("--text-field", default="content")
    index.add_argument("--chunk-size", type=int, default=1000)
    index.add_argument("--id-field")
    search = commands.add_parser("search", help="find chunks for a text")
    search.add_argument("query")
    search.add_argument("--top-k", type=int, default=10)
    export = commands.add_parser("export", help="rebuild the conversations of a group")
    export.add_argument("--file", required=True, help="messages as JSON lines")
    export.add_argument("--out", required=True)
    export.add_argument("--group-name", default="")
    export.add_argument("--group-id", type=int, default=0)
    export.add_argument("--start-id", type=int)
    export.add_argument("--limit", type=int, default=FETCH_LIMIT)
    export.add_argument("--reverse", action="store_true", help="oldest messages first")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parse_args(argv)
    if not args.command:
        print("No command given; see --help", file=sys.stderr)
        return 1
    spark = spark or get_session()
    indexer = Indexer(spark, args.root, HashingProvider(args.dimension), args.model, args.dimension)
    if args.command == "setup":
        return 0 if indexer.setup(args.recreate) else 1
    if args.command == "index":
        if not indexer.documents.path_exists(args.file):
            print(f"File not found: {args.file}", file=sys.stderr)
            return 1
        indexer.setup()
        print(f"Indexed {indexer.index_file(args.file, args.text_field, args.chunk_size, args.id_field).count()} documents")
        return 0
    if args.command == "search":
        indexer.search(args.query, args.top_k).show(args.top_k, truncate=100)
        return 0
    chunks, _, _ = export_conversations(spark, read_messages(spark, args.file), args.group_name, args.group_id, args.out, args.start_id, args.limit, args.reverse)
    print(f"Exported {chunks.count()} conversations")
    return 0


if __name__ == "__main__":
    sys.exit(main())
