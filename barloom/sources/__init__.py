"""Tables, ticks and sinks."""
