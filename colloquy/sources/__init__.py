"""Tables, files and audio that the library reads and writes."""
