"""Sources and sinks: put logs, stored state, binary key files."""
