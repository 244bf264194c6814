"""Where notes come from: folders of files, tables, dumps, and the generated corpus."""
