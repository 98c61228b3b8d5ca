"""Tables, views, files and workbooks."""
