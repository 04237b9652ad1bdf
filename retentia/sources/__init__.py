from retentia.sources.tables import materialize, read_parts, read_table, register, scratch_path, write_table

__all__ = ["materialize", "read_parts", "read_table", "register", "scratch_path", "write_table"]
