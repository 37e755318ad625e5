"""sparkloom: text analytics over logs, build output, diffs, source code, documents and conversations, as Spark DataFrame operators."""
