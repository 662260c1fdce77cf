"""Sources and sinks: tables of words, log files, records."""
