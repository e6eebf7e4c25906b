"""Where rows come from: files, tables, frames and the engine's own store."""
