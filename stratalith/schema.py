"""The tables of a project's knowledge base."""

TABLES = {
    "files": "relative_path string, language string, size bigint, modified timestamp, text string",
    "modules": "relative_path string, language string, line_count int, size int, summary string",
    "imports": "relative_path string, line int, module string, names array<string>, alias string",
    "classes": "relative_path string, language string, name string, start_line int, end_line int, depth bigint, bases array<string>, modifiers array<string>, docstring string, summary string",
    "functions": "relative_path string, start_line int, name string, end_line int, class_name string, parameters array<string>, modifiers array<string>, return_type string, calls array<string>, decorators array<string>, docstring string, is_private boolean, content string, summary string",
    "variables": "relative_path string, line int, name string, type_hint string, modifiers array<string>, class_name string, is_global boolean",
    "dependencies": "path string, depends_on string",
    "definitions": "relative_path string, id string, pos struct<relative_path: string, start_line: int, name: string>, name string",
    "calls": "relative_path string, caller string, callee string, name string",
    "pending": "relative_path string, name string",
    "edges": "src string, dst string",
    "metadata": "key string, value string, updated timestamp",
    "code_index": "kind string, name string, path string, start_line int, end_line int, signature string, pos bigint, key string, keywords array<string>, tags array<string>, tokens bigint",
    "analyses": "target_type string, target_name string, path string, code_hash string, result string, manually_corrected boolean, updated timestamp",
}

#: The tables in hash buckets, with the column that decides a row's bucket; edges lie by the simple name that was called.
BUCKETED = {
    "files": "relative_path", "modules": "relative_path", "imports": "relative_path", "classes": "relative_path", "functions": "relative_path",
    "variables": "relative_path", "dependencies": "path", "code_index": "path", "definitions": "name", "calls": "name", "edges": "dst",
}
